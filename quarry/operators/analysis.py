"""Analysis of module source files as DataFrames of lines: routines, calls, assignments, types, diagnostics.

Files are rows (path, content). Lines are exploded with their numbers, a routine's extent is found
by windows within its file, and every rule is a column expression over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import cut

#: The bilingual words that begin and end routines, and words that look like calls but are none.
BEGIN = r"(?iu)^\s*(Процедура|Функция|Procedure|Function)\s+([\p{L}_][\p{L}\p{N}_]*)\s*\(([^)]*)\)\s*(Экспорт|Export)?"
END = r"(?iu)^\s*(КонецПроцедуры|КонецФункции|EndProcedure|EndFunction)\b"
CALL = r"(?u)(?<![\p{L}\p{N}_.])([\p{L}_][\p{L}\p{N}_]*)\s*\("
KEYWORDS = ("если", "if", "пока", "while", "иначеесли", "elsif", "и", "and", "или", "or", "не", "not", "возврат", "return", "новый", "new", "процедура", "procedure", "функция", "function")
RETURN = r"(?iu)^\s*(?:Возврат|Return)\s+(.+?);"
ASSIGN = r"(?u)^\s*([\p{L}_][\p{L}\p{N}_]*)\s*=\s*(.+?);?\s*$"

#: Certainty of a dotted expression's parts.
BASE_SURE, PROPERTY_SURE, METHOD_SURE = 0.8, 0.9, 0.7


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the module files (.bsl, .os) below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{bsl,os}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


#: A line up to its comment.
CODE = r'^((?:[^"/]++|"(?:[^"]++|"")*+"?|/(?!/))*+)'


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1) and code: the line without its comment; string literals keep their slashes."""
    return files.select("path", F.posexplode(line_array(F.col("content"))).alias("line", "code")).withColumn("line", F.col("line") + 1)


#: What a statement line ends with if it is whole, and words that begin a statement whatever came before.
WHOLE = r"(?iu)(?:;|\b(?:Тогда|Then|Цикл|Do|Иначе|Else|Попытка|Try|Исключение|Except)|\b(?:КонецПроцедуры|EndProcedure|КонецФункции|EndFunction|КонецЕсли|EndIf|КонецЦикла|EndDo|КонецПопытки|EndTry))\s*$|^\s*[&#]"
HEAD = r"(?iu)^\s*(?:Процедура|Функция|Procedure|Function)\s"
FRESH = r"(?iu)^\s*(?:Процедура|Функция|Procedure|Function|КонецПроцедуры|КонецФункции|EndProcedure|EndFunction|Если|If|ИначеЕсли|ElsIf|Иначе|Else|КонецЕсли|EndIf|Пока|While|Для|For|КонецЦикла|EndDo|Попытка|Try|Исключение|Except|КонецПопытки|EndTry|Возврат|Return|Перем|Var)\b"


def line_array(content: Column) -> Column:
    """The lines of a file in order, each without its comment; string literals keep their slashes."""
    return F.transform(F.split(content, "\r?\n"), lambda raw: F.when(raw.contains("//"), F.regexp_extract(raw, CODE, 1)).otherwise(raw))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _statement_step(held: Column, x: Column) -> Column:
    """One line more: it begins a statement, goes on with the one before, or is blank."""
    ends = x["closes"] & F.coalesce(held["head"] > held["closed"], F.lit(False))
    starts = held["whole"] | x["code"].rlike(FRESH)  # the pattern is tried only behind a line that isn't whole
    this = F.struct(x["line"].alias("line"), x["code"].alias("code"))
    longer = F.struct(held["now"]["line"].alias("line"), F.concat_ws(" ", F.trim(held["now"]["code"]), F.trim(x["code"])).alias("code"))
    before = F.filter(F.array(held["now"]), lambda s: s.isNotNull())
    none = F.slice(held["blanks"], 1, 0)
    fields = {
        "done": F.when(x["blank"] | ~starts, held["done"]).otherwise(F.concat(held["done"], before, held["blanks"])),
        "now": F.when(x["blank"], held["now"]).when(starts, this).otherwise(longer),
        "blanks": F.when(x["blank"], F.concat(held["blanks"], F.array(this))).when(starts, none).otherwise(held["blanks"]),
        "whole": F.when(x["blank"], held["whole"]).otherwise(x["whole"] | ends),
        "head": F.when(x["opens"], x["line"]).otherwise(held["head"]),
        "closed": F.when(x["closes"], x["line"]).otherwise(held["closed"]),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def statement_array(lines_: Column) -> Column:
    """line and code of a file's lines (``line_array``), in order: statements over several lines are put together on the first, blank lines stay.

    A line goes on in the next one unless it ends with a semicolon, a block's word or a routine's
    head, or the next one begins with such a word. A head over several lines ends with the first
    bracket that closes.
    """
    row = "struct<line:int,code:string>"
    headed = lambda code, i: F.struct((i + 1).cast("int").alias("line"), code.alias("code"), code.rlike(HEAD).alias("headed"))
    begun = lambda x: F.struct(x["line"], x["code"], x["headed"], (x["headed"] & x["code"].rlike(BEGIN)).alias("head"))
    told = lambda x: F.struct(
        x["line"], x["code"], (F.trim(x["code"]) == "").alias("blank"), (x["headed"] & ~x["head"]).alias("opens"), x["code"].contains(")").alias("closes"), (F.rtrim(x["code"]).endswith(";") | x["head"] | x["code"].rlike(WHOLE)).alias("whole"),
    )
    start = F.struct(F.array().cast(f"array<{row}>").alias("done"), F.lit(None).cast(row).alias("now"), F.array().cast(f"array<{row}>").alias("blanks"), F.lit(True).alias("whole"), F.lit(None).cast("int").alias("head"), F.lit(0).alias("closed"))
    each = F.transform(F.transform(F.transform(lines_, headed), begun), told)
    return F.aggregate(each, start, _statement_step, lambda s: F.concat(s["done"], F.filter(F.array(s["now"]), lambda x: x.isNotNull()), s["blanks"]))


def statements(rows: DataFrame) -> DataFrame:
    """``rows`` of all lines of files with their statements put together (``statement_array``)."""
    files = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "code")))["code"].alias("_codes"))
    return files.select("path", F.inline(statement_array(F.col("_codes"))))


def in_routines(rows: DataFrame) -> DataFrame:
    """``rows`` of lines with ``routine``: the routine that holds the line, null outside."""
    begins = F.when(F.col("code").rlike(BEGIN), F.regexp_extract("code", BEGIN, 2))
    ended = F.col("code").rlike(END)
    order = Window.partitionBy("path").orderBy("line")
    marked = rows.withColumn("_b", begins).withColumn("_last", F.last(F.when(F.col("_b").isNotNull(), F.struct(F.col("line").alias("l"), "_b")), ignorenulls=True).over(order))
    gone = F.coalesce(F.max(F.when(ended, F.col("line"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_gone", gone).withColumn("routine", F.when(F.col("_last.l") > F.col("_gone"), F.col("_last._b"))).drop("_b", "_last", "_gone")


def routines(files: DataFrame) -> DataFrame:
    """path, line, name, kind, parameters, n_parameters and exported."""
    found = lines(files).where(F.col("code").rlike(BEGIN))
    text = F.trim(F.regexp_extract("code", BEGIN, 3))
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(F.regexp_replace(p, r"(?iu)^\s*(Знач|Val)\s+|=.*$", ""))), lambda p: p != "")
    kind = F.when(F.lower(F.regexp_extract("code", BEGIN, 1)).isin("функция", "function"), "function").otherwise("procedure")
    return found.select("path", "line", F.regexp_extract("code", BEGIN, 2).alias("name"), kind.alias("kind"), parts.alias("parameters"), F.size(parts).alias("n_parameters"), (F.regexp_extract("code", BEGIN, 4) != "").alias("exported"))


def call_edges(files: DataFrame) -> DataFrame:
    """path, line, caller and callee: calls by name within routines; the name of a routine may be declared anywhere or nowhere."""
    body = in_routines(lines(files)).where(F.col("routine").isNotNull() & ~F.col("code").rlike(BEGIN))
    plain = F.regexp_replace("code", r'"(?:[^"]|"")*"', '""')
    each = body.select("path", "line", F.col("routine").alias("caller"), F.explode(F.regexp_extract_all(plain, F.lit(CALL), F.lit(1))).alias("callee"))
    return each.where(~F.lower("callee").isin(*KEYWORDS))


def is_word(text: Column, *words: str) -> Column:
    """Whether a text is one of some lower-case words in either case; what looks like none isn't lowered, which is slow."""
    return text.rlike(rf"(?iu)^(?:{'|'.join(words)})$") & F.lower(text).isin(*words)


def expression_type(text: Column) -> Column:
    """The type of a simple expression: literals, comparisons, arithmetic, new objects; else null."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r'^"(?:[^"]|"")*"$'), "String")
        .when(t.rlike(r"^'\d+'$"), "Date")
        .when(is_word(t, "истина", "ложь", "true", "false"), "Boolean")
        .when(is_word(t, "неопределено", "undefined"), "Undefined")
        .when(t.rlike(r"(?iu)^(Новый|New)\s+[\p{L}_]"), F.regexp_extract(t, r"(?iu)^(?:Новый|New)\s+([\p{L}_][\p{L}\p{N}_]*)", 1))
        .when(t.rlike(r'(<>|<=|>=|<|>)') & ~t.contains('"'), "Boolean")
        .when(t.contains('"') & t.contains("+"), "String")
        .when(t.rlike(r"^[-\d.\s+*/()]+$") & t.rlike(r"\d"), "Number")
    )


def returns(files: DataFrame) -> DataFrame:
    """path, routine and types: the distinct types of a routine's returns; a routine that returns nothing is Void."""
    body = in_routines(lines(files)).where("routine IS NOT NULL")
    value = F.when(F.col("code").rlike(RETURN), F.coalesce(expression_type(F.regexp_extract("code", RETURN, 1)), F.lit("Unknown")))
    return body.groupBy("path", "routine").agg(F.array_sort(F.collect_set(value)).alias("_t")).select("path", "routine", F.when(F.size("_t") > 0, F.array_join("_t", "|")).otherwise("Void").alias("types"))


def assignments(files: DataFrame) -> DataFrame:
    """path, line, routine, variable, value and type of plain assignments."""
    rows = in_routines(lines(files)).where(F.col("code").rlike(ASSIGN))
    value = F.regexp_extract("code", ASSIGN, 2)
    return rows.select("path", "line", "routine", F.regexp_extract("code", ASSIGN, 1).alias("variable"), value.alias("value"), expression_type(value).alias("type"))


def dependency_edges(files: DataFrame) -> DataFrame:
    """path, src, dst and kind: a variable on what its value names (assignment or call), a routine on what it calls."""
    plain = F.regexp_replace("value", r'"(?:[^"]|"")*"', "")
    names = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?u)(?<![\p{L}\p{N}_.])([\p{L}_][\p{L}\p{N}_]*\s*\(?)"), F.lit(1)))
    each = assignments(files).select("path", F.col("variable").alias("src"), F.explode(names).alias("n"))
    target = F.trim(F.regexp_replace("n", r"\(", ""))
    values = each.select("path", "src", target.alias("dst"), F.when(F.col("n").contains("("), "call_result").otherwise("assignment").alias("kind"))
    calls = call_edges(files).select("path", F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("call").alias("kind"))
    return values.where(~F.lower("dst").isin(*KEYWORDS, "истина", "ложь", "true", "false", "неопределено", "undefined")).union(calls).distinct()


def flow_types(files: DataFrame) -> DataFrame:
    """path, routine, variable and types: the union over all of its assignments, unknown ones told."""
    known = F.coalesce("type", F.lit("Unknown"))
    return assignments(files).groupBy("path", "routine", "variable").agg(F.array_join(F.array_sort(F.collect_set(known)), "|").alias("types"), F.count(F.lit(1)).alias("assignments"))


def diagnostics(files: DataFrame) -> DataFrame:
    """path, line, severity and message: wrong numbers of arguments, unknown routines, changed types."""
    declared = routines(files).select("path", F.col("name").alias("callee"), "n_parameters")
    body = in_routines(lines(files)).where(F.col("routine").isNotNull() & ~F.col("code").rlike(BEGIN))
    plain = F.regexp_replace("code", r'"(?:[^"]|"")*"', '""')
    inner = F.regexp_extract_all(plain, F.lit(r"(?u)(?<![\p{L}\p{N}_.])([\p{L}_][\p{L}\p{N}_]*\s*\([^()]*\))"), F.lit(1))
    calls = body.select("path", "line", F.explode(inner).alias("c")).select("path", "line", F.trim(F.regexp_extract("c", r"^([^(]*)\(", 1)).alias("callee"), F.trim(F.regexp_extract("c", r"\((.*)\)$", 1)).alias("args")).where(~F.lower("callee").isin(*KEYWORDS))
    given = F.when(F.col("args") == "", 0).otherwise(F.size(F.split("args", ",")))
    met = calls.withColumn("given", given).join(declared, ["path", "callee"], "left")
    arity = met.where("n_parameters IS NOT NULL AND given > n_parameters").select("path", "line", F.lit("error").alias("severity"), F.format_string("%s takes %d arguments, not %d", "callee", "n_parameters", "given").alias("message"))
    unknown = met.where("n_parameters IS NULL").select("path", "line", F.lit("info").alias("severity"), F.format_string("%s is not declared here", "callee").alias("message"))
    before = F.lag("type").over(Window.partitionBy("path", "routine", "variable").orderBy("line"))
    changed = assignments(files).where("type IS NOT NULL").withColumn("_b", before).where("_b <> type").select("path", "line", F.lit("warning").alias("severity"), F.format_string("%s was %s and becomes %s", "variable", "_b", "type").alias("message"))
    return arity.unionByName(unknown).unionByName(changed)


def narrowing(condition: Column) -> tuple[Column, Column, Column]:
    """variable, type within the branch and type in the other one, for the conditions that narrow."""
    type_of = r"""(?iu)^\s*(?:ТипЗнч|TypeOf)\(\s*([\p{L}_][\p{L}\p{N}_]*)\s*\)\s*=\s*(?:Тип|Type)\(\s*"([^"]+)"\s*\)\s*$"""
    none = r"(?iu)^\s*([\p{L}_][\p{L}\p{N}_]*)\s*(=|<>)\s*(Неопределено|Undefined|NULL)\s*$"
    variable = F.when(condition.rlike(type_of), F.regexp_extract(condition, type_of, 1)).when(condition.rlike(none), F.regexp_extract(condition, none, 1))
    absent = F.when(F.upper(F.regexp_extract(condition, none, 3)) == "NULL", "Null").otherwise("Undefined")
    equal = F.regexp_extract(condition, none, 2) == "="
    within = F.when(condition.rlike(type_of), F.regexp_extract(condition, type_of, 2)).when(condition.rlike(none), F.when(equal, absent).otherwise(F.concat(F.lit("not "), absent)))
    other = F.when(within.startswith("not "), F.substring(within, F.lit(5), F.length(within))).otherwise(F.concat(F.lit("not "), within))
    return variable, within, other


#: Type names that a type check may give, and the types that they stand for.
CHECKED_TYPES = {
    "Строка": "String", "String": "String", "Число": "Number", "Number": "Number", "Булево": "Boolean", "Boolean": "Boolean", "Дата": "Date", "Date": "Date",
    "Массив": "Array", "Array": "Array", "Соответствие": "Map", "Map": "Map", "Структура": "Structure", "Structure": "Structure", "ТаблицаЗначений": "ValueTable", "ValueTable": "ValueTable",
}


def refinement(condition: Column) -> Column:
    """variable, type and kind that a condition gives its branch; null where it gives none.

    Type checks by name (equal or not), comparison with Undefined and Null (the type of what is
    not one of them stays open), a bare name (truthy) and NOT before one (falsy, Boolean).
    """
    name = r"([\p{L}_][\p{L}\p{N}_]*)"
    checked = rf"""(?u)^\s*(?:ТипЗнч|TypeOf)\(\s*{name}\s*\)\s*(=|<>)\s*(?:Тип|Type)\(\s*"([^"]+)"\s*\)\s*$"""
    absent = rf"(?u)^\s*{name}\s*(=|<>)\s*(Неопределено|Undefined|Null)\s*$"
    bare, negated = rf"(?u)^\s*{name}\s*$", rf"(?iu)^\s*(?:НЕ|NOT)\s+{name}\s*$"
    types = F.create_map(*[F.lit(x) for pair in CHECKED_TYPES.items() for x in pair])
    made = lambda variable, type_, kind: F.struct(variable.alias("variable"), type_.alias("type"), kind.alias("kind"))
    equal = lambda pattern: F.regexp_extract(condition, pattern, 2) == "="
    known = F.try_element_at(types, F.regexp_extract(condition, checked, 3))
    none = F.when(F.regexp_extract(condition, absent, 3) == "Null", "Null").otherwise("Undefined")
    return (
        F.when(condition.rlike(checked) & known.isNotNull(), made(F.regexp_extract(condition, checked, 1), known, F.when(equal(checked), "type is").otherwise("type is not")))
        .when(condition.rlike(absent), made(F.regexp_extract(condition, absent, 1), F.when(equal(absent), none), F.concat(F.when(equal(absent), "equals ").otherwise("not equals "), none)))
        .when(condition.rlike(negated), made(F.regexp_extract(condition, negated, 1), F.lit("Boolean"), F.lit("falsy")))
        .when(condition.rlike(bare), made(F.regexp_extract(condition, bare, 1), F.lit(None).cast("string"), F.lit("truthy")))
    )


#: Words in a parent, and methods, that tell a facet.
FACET_PARENTS = (("Справочники", "Manager"), ("Catalogs", "Manager"), ("Метаданные", "Metadata"), ("Metadata", "Metadata"))
FACET_METHODS = {"СоздатьЭлемент": "Object", "CreateItem": "Object", "НайтиПоКоду": "Reference", "FindByCode": "Reference"}


def facet_of(parent: Column, method: Column) -> Column:
    """The facet that holds in a context: by its parent, else by its method, else a reference."""
    out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FACET_METHODS.items() for x in pair]), method), F.lit("Reference"))
    for word, facet in reversed(FACET_PARENTS):
        out = F.when(parent.contains(word), facet).otherwise(out)
    return out


def switch_facet(active: Column, wanted: Column, available: Column) -> Column:
    """The wanted facet if the type has it, else the one that was active."""
    return F.when(F.array_contains(available, wanted), wanted).otherwise(active)


def check_text(variable: Column, type_: Column, confidence: Column, mode: str, certain: float = 0.8) -> Column:
    """A check for a type that is not certain, by mode: a note, an assertion or a log entry; a null type is known not at all."""
    unsure = F.when(type_.isNull() | (confidence < certain), True)
    named = F.coalesce(type_, F.lit("any type"))
    texts = {
        "warning": F.format_string("// %s: %s is not certain", variable, named),
        "assert": F.when(type_.isNull(), F.format_string('If NOT ValueIsFilled(%s) Then Raise "%s is empty"; EndIf;', variable, variable)).otherwise(F.format_string('If TypeOf(%s) <> Type("%s") Then Raise "%s: %s expected"; EndIf;', variable, named, variable, named)),
        "report": F.format_string('WriteLogEvent("Types", , , "%s: " + String(TypeOf(%s)));', named, variable),
    }
    return F.when(unsure, texts[mode])


def line_assignments(text_rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, left and right of each line's first ``=``; lines with ==, <= or >= and comment lines are passed over."""
    each = text_rows.select(key, F.posexplode(F.split(text, "\n")).alias("line", "code"))
    plain = F.col("code").contains("=") & ~F.col("code").rlike("==|<=|>=") & ~F.ltrim("code").startswith("//")
    return each.where(plain).select(key, "line", F.trim(F.substring_index("code", "=", 1)).alias("left_side"), F.trim(F.regexp_extract("code", "(?s)=(.*)$", 1)).alias("right_side"))


def resolve_path(paths: DataFrame, members: DataFrame, path: str = "path") -> DataFrame:
    """path, type and confidence of dotted expressions ``Base.member``: the member's type by the table of members.

    ``members`` has owner, name, kind (method or property) and type. Paths without a dot are their
    base; an unknown member gives no type.
    """
    parts = paths.select(path, F.split(path, r"\.").alias("_p"))
    one = parts.where(F.size("_p") == 1).select(path, F.get("_p", F.lit(0)).alias("type"), F.lit(BASE_SURE).alias("confidence"))
    two = parts.where(F.size("_p") == 2).join(members, (F.col("owner") == F.get("_p", F.lit(0))) & (F.col("name") == F.get("_p", F.lit(1))), "left")
    sure = F.when(F.col("kind") == "method", METHOD_SURE).when(F.col("kind") == "property", PROPERTY_SURE).otherwise(0.0)
    far = parts.where(F.size("_p") > 2).select(path, F.lit(None).cast("string").alias("type"), F.lit(0.0).alias("confidence"))
    return one.union(two.select(path, "type", sure.alias("confidence"))).union(far)


def resolve_paths(paths: DataFrame, members: DataFrame, path: str = "path") -> DataFrame:
    """path, type and confidence of dotted expressions of any length: each step takes the member's type as the next owner.

    The confidence is that of the last step; an unknown member gives no type. A step is one join,
    and a scratch table ends every tenth, so the plan doesn't grow with the length.
    """
    parts = paths.select(path, F.split(path, r"\.").alias("_p"))
    steps = parts.agg(F.coalesce(F.max(F.size("_p")), F.lit(1))).first()[0]
    now = parts.select(path, "_p", F.get("_p", F.lit(0)).alias("_t"), F.lit(BASE_SURE).alias("_sure"))
    table = members.select(F.col("owner").alias("_o"), F.col("name").alias("_m"), F.col("kind").alias("_k"), F.col("type").alias("_n"))
    for k in range(1, steps):
        met = now.join(table, (F.col("_t") == F.col("_o")) & (F.get("_p", F.lit(k)) == F.col("_m")), "left")
        far = F.size("_p") > k
        sure = F.when(F.col("_k") == "method", METHOD_SURE).when(F.col("_k") == "property", PROPERTY_SURE).otherwise(0.0)
        now = met.select(path, "_p", F.when(far, F.col("_n")).otherwise(F.col("_t")).alias("_t"), F.when(far, sure).otherwise(F.col("_sure")).alias("_sure"))
        now = cut(now) if k % 10 == 0 else now
    return now.select(path, F.col("_t").alias("type"), F.col("_sure").alias("confidence"))


def assignment_diagnostics(text_rows: DataFrame, key: str, text: str, typed: DataFrame) -> DataFrame:
    """key, line, severity and message: assignments whose value's type isn't that of the variable; what has no type says nothing."""
    made = line_assignments(text_rows, key, text).withColumn("_value", expression_type(F.regexp_replace("right_side", r";\s*$", "")))
    met = made.join(typed.select(F.col("variable").alias("left_side"), F.col("type").alias("_has")), "left_side")
    return met.where("_value IS NOT NULL AND _value <> _has").select(key, "line", F.lit("warning").alias("severity"), F.format_string("%s is a %s and gets a %s", "left_side", "_has", "_value").alias("message"))


def contract(variable: Column, type_: Column, confidence: Column, certain: float = 0.8) -> Column:
    """A check to write before a use whose type is not certain; null where it is."""
    text = F.format_string('If TypeOf(%s) <> Type("%s") Then Raise "%s: %s expected"; EndIf;', variable, type_, variable, type_)
    return F.when(confidence < certain, text)


def type_hint(types: Column, confidence: Column, most: int = 3) -> Column:
    """``A|B~`` for up to ``most`` types, else ``Union<n>``; ~ where nearly sure, ? below, nothing where known (null confidence)."""
    base = F.when(F.size(types) <= most, F.array_join(types, "|")).otherwise(F.concat(F.lit("Union<"), F.size(types).cast("string"), F.lit(">")))
    return F.concat(base, F.when(confidence.isNull(), "").when(confidence >= 0.9, "~").otherwise("?"))


def code_action(message: Column) -> Column:
    """What to offer for a diagnostic."""
    return F.when(message.contains("not declared"), "declare").when(message.contains("arguments"), "fix the call").when(message.contains("becomes"), "add a check").when(message.contains("takes numbers") | message.rlike(r"is an? \w+ and gets"), "convert the value").otherwise("none")


def invert(condition: Column) -> Column:
    """The kind of narrowing in the ELSE branch."""
    pairs = {"equals": "not equals", "not equals": "equals", "type is": "type is not", "type is not": "type is", "truthy": "falsy", "falsy": "truthy"}
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), condition)


#: Global collections and the managers that their members are.
MANAGERS = {
    "Справочники": "CatalogManager", "Catalogs": "CatalogManager", "Документы": "DocumentManager", "Documents": "DocumentManager",
    "РегистрыСведений": "InformationRegisterManager", "InformationRegisters": "InformationRegisterManager", "Перечисления": "EnumManager", "Enums": "EnumManager",
}


def manager(path: Column) -> tuple[Column, Column]:
    """kind and confidence of a global manager path ``Catalogs.X``; more parts are unknown."""
    parts = F.split(path, r"\.")
    known = F.try_element_at(F.create_map(*[F.lit(x) for p in MANAGERS.items() for x in p]), F.get(parts, F.lit(0)))
    return F.when(F.size(parts) <= 2, known), F.when((F.size(parts) <= 2) & known.isNotNull(), F.when(F.size(parts) == 2, 0.8).otherwise(1.0)).otherwise(0.0)
