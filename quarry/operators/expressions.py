"""Types of expressions in module source, from the types of the names, calls and members in them.

An expression is a row. Its tokens are found by one pattern, what its names and calls are is joined
(what reaches the place, what the meant routine returns, what a type's member is), and one
aggregation along the tokens settles brackets and operators, so an expression of n tokens takes n
steps at any depth and its rows are moved only for the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import analysis as A
from . import flow as W
from .graph import cut, join_often

NAME = W.NAME
PATH = rf"{NAME}(?:\s*\.\s*{NAME})*"
#: Words that are operators; what follows is no letter.
WORDS = {"and": ("И", "AND"), "or": ("ИЛИ", "OR"), "not": ("НЕ", "NOT")}
_END = r"(?![\p{L}\p{N}_])"
_ANY_WORD = "|".join(w for pair in WORDS.values() for w in pair)
TOKEN = "|".join((
    r'"(?:[^"]++|"")*+"?', r"'\d*+'?", r"\d++(?:\.\d++)?", rf"(?:{_ANY_WORD}){_END}", rf"(?:Новый|New)\s+{NAME}\s*\(?", rf"{PATH}\s*[(\[]?", r"\?\s*\(",
    rf"[)\]](?:\s*\.\s*{NAME})++\s*[(\[]?", r"[)\]]\s*\[", r"[)\]]", "<>|<=|>=|[<>=]", r"[-+*/%(,]",
))

UNKNOWN = "Unknown"
#: What a problem of an expression says.
ARITHMETIC, SIGN, LOGIC, NEGATION, CONDITION = "operands that don't fit an arithmetic sign", "minus before what is no number", "AND or OR of what is no truth value", "NOT of what is no truth value", "condition that is no truth value"

_FRAME = {"call": "string", "nth": "int", "second": "string", "ors": "string", "ands": "string", "not": "boolean", "compared": "boolean", "sum": "string", "sign": "string", "product": "string", "minus": "boolean", "waits": "boolean"}


def tokens(text: Column) -> Column:
    """The tokens of an expression in order; what is none of them is passed over."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?iu)({TOKEN})"), F.lit(1)), lambda t: F.trim(t))


def _bare(token: Column) -> Column:
    """A path or call as it is looked up: without white space, a call with ``()``."""
    solid = F.when(token.rlike(r"\s"), F.regexp_replace(token, r"\s+", "")).otherwise(token)
    return F.when(token.endswith("("), F.concat(solid, F.lit(")"))).otherwise(solid)


def marks(text: Column) -> Column:
    """kind, type and name of an expression's tokens in order.

    Kinds: v operand, ( open, f call, ? choice, ) close, m and n close of a part with a member, else
    a sign's own letter. ``type`` is what a token tells by itself, ``name`` what is to be looked up
    (a name, dotted path or call: ``f()``, ``a.m()``); Unknown if there is neither.
    """
    new = rf"(?iu)^(?:Новый|New)\s+({NAME})"
    own, signs, alone = set(W.LITERALS), {w.lower() for pair in WORDS.values() for w in pair}, "\"'0123456789"

    def told(t: Column) -> Column:
        low = F.when(t.rlike(rf"(?iu)^(?:{'|'.join(sorted(own | signs))})$"), F.lower(t)).otherwise("")
        return F.struct(t.alias("token"), F.substring(t, 1, 1).alias("first"), low.alias("word"), F.regexp_extract(t, new, 1).alias("new"))

    def mark(x: Column) -> Column:
        t, first, word = x["token"], x["first"], lambda *words: x["word"].isin(*map(str.lower, words))
        closes = F.when(t.rlike(r"^[)\]].*[(\[]$"), "n").when(t.rlike(r"^[)\]]."), "m").otherwise(")")
        kind = (
            F.when(first.isin(*alone), "v").when(first.isin(*"+-(,"), first).when(first.isin(*"<>="), "=").when(first.isin(*"*/%"), "*").when(first == "?", "?").when(first.isin(")", "]"), closes)
            .when(t.endswith("(") | t.endswith("["), "f").when(word(*WORDS["and"]), "&").when(word(*WORDS["or"]), "|").when(word(*WORDS["not"]), "!").otherwise("v")
        )
        type_ = (
            F.when(first == '"', "String").when(first == "'", "Date").when(first.isin(*alone), "Number").when(word("истина", "ложь", "true", "false"), "Boolean")
            .when(word("неопределено", "undefined"), "Undefined").when(word("null"), "Null").when(x["new"] != "", x["new"])
        )
        plain = ~first.isin(*alone, *"+-(,<>=*/%?)]") & (x["word"] == "") & (x["new"] == "") & ~t.endswith("[")
        return F.struct(kind.alias("kind"), type_.alias("type"), F.when(plain, _bare(t)).alias("name"))

    return F.transform(tokens(text), lambda t: A.let(told(t), mark))


def _names(marked: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(marked, lambda m: m["name"]), lambda n: n.isNotNull()))


def operands(text: Column) -> Column:
    """The distinct names, dotted paths and calls (``f()``, ``a.m()``) of an expression whose types are asked."""
    return _names(marks(text))


def _frame(of: Column | None = None, **changes: Column) -> Column:
    """A level of brackets with some fields changed; a fresh one waits for its first operand."""
    start = {"nth": F.lit(1), "not": F.lit(False), "compared": F.lit(False), "minus": F.lit(False), "waits": F.lit(True)}
    field = lambda n, t: changes[n] if n in changes else of[n] if of is not None else start.get(n, F.lit(None))
    return F.struct(*[field(n, t).cast(t).alias(n) for n, t in _FRAME.items()])


def _wrong(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in rules]), lambda m: m.isNotNull())


def _joined(before: Column, now: Column, wanted: str) -> tuple[Column, Column]:
    """Type of two operands that must both be of one type, and whether they aren't; nothing before gives the second."""
    fits = (before == wanted) & (now == wanted)
    return F.when(before.isNull(), now).when(fits, wanted).otherwise(UNKNOWN), before.isNotNull() & ~fits


def _read(f: Column) -> Column:
    """What a level is so far: ``sum`` of its last terms, ``ands`` since the last OR, ``value`` of all, each with the problems of reading so far."""
    last = F.coalesce(f["product"], F.lit(UNKNOWN))
    text = (f["sum"] == "String") & (f["sign"] == "+")
    number, misfit = _joined(f["sum"], last, "Number")
    summed = F.struct(F.when(text, "String").otherwise(number).alias("sum"), _wrong((~text & misfit, ARITHMETIC)).alias("wrong"))

    def part(a: Column) -> Column:
        plain = F.when(f["compared"], "Boolean").otherwise(a["sum"])
        denied = f["not"] & (plain != "Boolean")
        return F.struct(a["sum"].alias("sum"), a["wrong"].alias("wrong"), F.when(denied, UNKNOWN).otherwise(plain).alias("part"), F.concat(a["wrong"], _wrong((denied, NEGATION))).alias("wrong_part"))

    def anded(b: Column) -> Column:
        ands, misfit = _joined(f["ands"], b["part"], "Boolean")
        return F.struct(b["sum"].alias("sum"), b["wrong"].alias("wrong"), ands.alias("ands"), F.concat(b["wrong_part"], _wrong((misfit, LOGIC))).alias("wrong_ands"))

    def ored(c: Column) -> Column:
        value, misfit = _joined(f["ors"], c["ands"], "Boolean")
        empty = f["waits"] & F.coalesce(f["sum"], f["product"], f["ands"], f["ors"]).isNull() & ~f["compared"]
        wrong = F.when(empty, F.array().cast("array<string>")).otherwise(F.concat(c["wrong_ands"], _wrong((misfit, LOGIC))))
        return F.struct(c["sum"].alias("sum"), c["wrong"].alias("wrong"), c["ands"].alias("ands"), c["wrong_ands"].alias("wrong_ands"), value.alias("value"), wrong.alias("wrong_value"))

    return A.let(A.let(A.let(summed, part), anded), ored)


def _operand(f: Column, type_: Column) -> tuple[Column, Column]:
    """A level with one operand more, and what is wrong with it."""
    signed = f["minus"] & (type_ != "Number")
    product, misfit = _joined(f["product"], F.when(signed, UNKNOWN).otherwise(type_), "Number")
    return _frame(f, product=product, minus=F.lit(False), waits=F.lit(False)), _wrong((signed, SIGN), (misfit, ARITHMETIC))


def _step(s: Column, token: Column) -> Column:
    f, kind, type_ = s["top"], token["kind"], token["type"]
    none = F.lit(None)
    fresh = {"not": F.lit(False), "compared": F.lit(False), "sum": none, "sign": none, "product": none, "minus": F.lit(False), "waits": F.lit(True)}

    def made(top: Column, rest: Column = s["rest"], *wrong: Column) -> Column:
        return F.struct(top.alias("top"), rest.alias("rest"), (F.concat(s["problems"], *wrong) if wrong else s["problems"]).alias("problems"))

    def ends(r: Column) -> Column:
        """Signs and brackets before which something ends; ``r`` is what the level is so far."""
        outer, inner = s["rest"][0], F.slice(s["rest"], F.lit(2), F.greatest(F.size(s["rest"]) - 1, F.lit(0)))
        chosen = F.coalesce(F.when(f["nth"] == 2, r["value"]).otherwise(f["second"]), F.lit(UNKNOWN))
        back = F.when(kind == "m", UNKNOWN).when(f["call"] == "?", chosen).otherwise(F.coalesce(f["call"], r["value"]))
        closed, misfit = _operand(outer, back)
        asked = _wrong(((f["call"] == "?") & (f["nth"] == 1) & (r["value"] != "Boolean"), CONDITION))
        comma = _frame(f, **fresh | {"nth": f["nth"] + 1, "second": F.when(f["nth"] == 2, r["value"]).otherwise(f["second"]), "ors": none, "ands": none})
        return (
            F.when(kind.isin("+", "-"), made(_frame(f, sum=r["sum"], sign=kind, product=none, waits=F.lit(True)), s["rest"], r["wrong"]))
            .when(kind == "=", made(_frame(f, **fresh | {"not": f["not"], "compared": F.lit(True)}), s["rest"], r["wrong"]))
            .when(kind == "&", made(_frame(f, **fresh | {"ands": r["ands"]}), s["rest"], r["wrong_ands"]))
            .when(kind == "|", made(_frame(f, **fresh | {"ands": none, "ors": r["value"]}), s["rest"], r["wrong_value"]))
            .when(kind == ",", made(comma, s["rest"], r["wrong_value"], asked))
            .when(kind == "n", made(_frame(call=F.lit(UNKNOWN)), s["rest"], r["wrong_value"]))
            .otherwise(made(closed, inner, r["wrong_value"], misfit))
        )

    operand, misfit = _operand(f, type_)
    call = F.when(kind == "f", type_).when(kind == "?", "?")
    unary = kind.isin("+", "-") & f["waits"]
    return (
        F.when(kind == "v", made(operand, s["rest"], misfit))
        .when(kind.isin("(", "f", "?"), made(_frame(call=call), F.array_prepend(s["rest"], f)))
        .when(kind.isin(")", "m", "n") & (F.size(s["rest"]) == 0), s)
        .when(kind == "*", made(_frame(f, waits=F.lit(True)))).when(unary, made(_frame(f, minus=f["minus"] | (kind == "-"))))
        .when(kind == "!", made(_frame(f, **{"not": F.lit(True)})))
        .otherwise(A.let(_read(f), ends))
    )


def typed(text: Column, types: Column, marked: Column | None = None) -> Column:
    """type and problems of an expression, whose operands have the types of a map (``operands`` are its keys); ``marked`` are its ``marks``, if read before.

    NOT binds after comparisons and before AND, AND before OR. Sums are read from the left: numbers
    give a number, a text with a plus gives a text whatever follows, all else is Unknown.
    Comparisons are Boolean whatever they compare; AND, OR and NOT need Boolean operands. A choice
    ``?(c, a, b)`` has the type of a, an index and a member of a computed value are Unknown, and so
    is an operand that the map doesn't know. Each misfit is a problem, in the order of the tokens.
    Null has a null type; an empty text is Unknown without problems; what is left open counts as
    closed, and a bracket that closes nothing is passed over.
    """
    start = F.struct(_frame().alias("top"), F.array().cast(f"array<struct<{','.join(f'`{n}`:{t}' for n, t in _FRAME.items())}>>").alias("rest"), F.array().cast("array<string>").alias("problems"))
    closing = F.struct(F.lit(")").alias("kind"), F.lit(None).cast("string").alias("type"))
    # What is left open closes at the end; closes that are too many are passed over.
    all_ = lambda ts: F.concat(ts, F.array_repeat(closing, F.size(F.filter(ts, lambda t: t["kind"].isin("(", "f", "?")))))
    told = F.transform(marks(text) if marked is None else marked, lambda m: F.struct(m["kind"].alias("kind"), F.coalesce(m["type"], F.try_element_at(types, m["name"]), F.lit(UNKNOWN)).alias("type")))
    ended = lambda s: A.let(_read(s["top"]), lambda r: F.struct(F.when(F.trim(text) == "", UNKNOWN).otherwise(r["value"]).alias("type"), F.concat(s["problems"], r["wrong_value"]).alias("problems")))
    read = lambda ts: A.let(F.aggregate(all_(ts), start, _step), ended)
    # One operand is what it is.
    alone = lambda ts: F.struct(ts[0]["type"].alias("type"), F.array().cast("array<string>").alias("problems"))
    return F.when(text.isNotNull(), A.let(told, lambda ts: F.when((F.size(ts) == 1) & (F.get(ts, F.lit(0))["kind"] == "v"), alone(ts)).otherwise(read(ts))))


def with_types(expressions: DataFrame, keys: list[str], names: DataFrame, calls: DataFrame, members: DataFrame, text: str = "text") -> DataFrame:
    """``expressions`` with type and problems.

    ``names`` (keys, name, type) tells what names hold at an expression, ``calls`` (keys, name,
    type) what its calls of plain names return, ``members`` (owner, name, kind, type) the members of
    types. Several types of one name are a union ``A|B``, which fits no operator. ``keys`` tell an
    expression; rows that are equal in them must be equal in text.
    """
    none, union = F.create_map().cast("map<string,string>"), lambda types: F.array_join(F.array_sort(F.array_distinct(types)), "|")
    columns = expressions.columns
    given = expressions if "_marks" in columns else expressions.withColumn("_marks", marks(F.col(text)))
    given = given.withColumn("_names", _names(F.col("_marks")))
    known = lambda df, types: df.withColumn("_t", typed(F.col(text), types, F.col("_marks"))).select(*[c for c in columns if c != "_marks"], "_t.type", "_t.problems")
    asks = F.coalesce(F.size("_names") > 0, F.lit(False))
    # An expression and all that is told of it are gathered in one row.
    whole = given.where(asks).select(*keys, F.struct(*given.columns).alias("_e"), F.lit(None).cast("struct<name:string,call:boolean,type:string>").alias("_n"))
    entry = lambda df, call: df.dropna(subset=keys).select(*keys, F.lit(None).cast(whole.schema["_e"].dataType).alias("_e"), F.struct("name", F.lit(call).alias("call"), "type").alias("_n"))
    every = whole.unionByName(entry(names, False)).unionByName(entry(calls, True)).groupBy(F.xxhash64(*keys).alias("_h"), *keys).agg(F.collect_list("_e").alias("_e"), F.collect_set("_n").alias("_n"))
    met = every.where("size(_e) > 0").withColumn("_names", F.array_distinct(F.flatten(F.transform("_e", lambda e: e["_names"]))))

    def part(o: Column) -> Column:
        call = o.endswith("()")
        plain = F.when(call, F.substring(o, F.lit(1), F.length(o) - 2)).otherwise(o)
        return F.struct(o.alias("o"), F.substring_index(plain, ".", 1).alias("base"), F.when(plain.contains("."), F.substring(plain, F.instr(plain, ".") + 1, F.length(plain))).alias("more"), (call & ~plain.contains(".")).alias("call"))

    def based(p: Column) -> Column:
        types = F.transform(F.filter("_n", lambda n: (n["name"] == p["base"]) & (n["call"] == p["call"])), lambda n: n["type"])
        return F.struct(p["o"].alias("o"), p["more"].alias("more"), F.when(F.size(types) > 0, union(types)).alias("type"))

    parts = F.transform(F.transform("_names", part), based)
    met = met.select(*keys, "_e", parts.alias("_parts"))
    direct = F.map_from_entries(F.transform(F.filter("_parts", lambda p: p["more"].isNull() & p["type"].isNotNull()), lambda p: F.struct(p["o"], p["type"])))
    flat = lambda df, types: known(df.select(types.alias("_types"), F.inline("_e")), F.coalesce("_types", none))
    met = met.withColumn("_direct", direct)
    alone = known(given.where(~asks), none)
    if given.where(F.exists("_names", lambda o: o.contains("."))).isEmpty():
        return alone.unionByName(flat(met, F.col("_direct")))
    met = cut(met)
    more = F.transform(F.filter("_parts", lambda p: p["more"].isNotNull()), lambda p: F.struct(p["o"].alias("_o"), F.concat_ws(".", F.coalesce(p["type"], F.lit(UNKNOWN)), p["more"]).alias("_path")))
    dotted = met.where(F.exists("_parts", lambda p: p["more"].isNotNull())).select(*keys, F.inline(more))
    found = cut(A.resolve_paths(dotted.select("_path").distinct(), members, "_path").where("type IS NOT NULL").select("_path", "type"))
    if found.isEmpty():
        return alone.unionByName(flat(met, F.col("_direct")))
    far = join_often(dotted, found, ["_path"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_o", "type"))).alias("_far"))
    return alone.unionByName(flat(met.join(far, keys, "left"), F.when(F.col("_far").isNull(), F.col("_direct")).otherwise(F.map_concat("_direct", "_far"))))


def told(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` of the assigned value, returned value or condition of a line in a routine, and its ``_marks``; as they are if they have them."""
    if "_marks" in rows.columns:
        return rows
    asked = F.when(F.col("kind").isNotNull() & F.col("code").rlike(W.CONDITION), F.regexp_extract("code", W.CONDITION, 1))
    text = F.when(F.col("routine").isNotNull(), F.trim(F.coalesce(asked, "back", "value")))
    return W.told(rows).withColumn("text", text).withColumn("_marks", F.when(F.col("text").isNotNull(), marks(F.col("text"))))


def points(rows: DataFrame) -> DataFrame:
    """path, routine, line, place and variable: names that the expressions of ``rows`` ask for, those that are a value or returned value by themselves among them."""
    used = F.filter("_names", lambda o: ~o.endswith("()") | o.contains("."))
    bases = F.transform(used, lambda o: F.substring_index(o, ".", 1))
    by_form = F.transform(F.filter(F.array("given", "returned"), lambda n: n.startswith("name:")), lambda n: F.substring(n, 6, 1 << 20))
    read = told(rows).where("text IS NOT NULL").withColumn("_names", _names(F.col("_marks")))
    return read.select("path", "routine", "line", "place", F.explode(F.array_distinct(F.concat(bases, by_form))).alias("variable"))


def in_files(rows: DataFrame, placed: DataFrame | None, returns: DataFrame, members: DataFrame, whole: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """path, routine, line, text, type and problems of every assigned value, returned value and condition of ``rows`` (``flow.blocks``).

    Names hold what reaches them, by ``names`` (``flow.held`` at ``points``) or by the assignments
    ``placed`` (of ``flow.typed_assignments``); calls return what the routine that they mean returns
    (``returns``: path, routine, type).
    """
    keys = ["path", "routine", "line"]
    rows = told(rows)
    each = rows.where("text IS NOT NULL").select(*keys, "text", "_marks")
    met = names if names is not None else W.reaching(rows, placed, points(rows), whole)
    called = F.transform(F.filter(_names(F.col("_marks")), lambda o: o.endswith("()") & ~o.contains(".")), lambda o: F.regexp_replace(o, r"\(\)$", ""))
    own = each.select(*keys, F.explode(called).alias("name")).select(*keys, "name", F.lit(True).alias("call"), F.concat(F.lit("call:"), "name").alias("type"))
    told_ = W.answered(met.select(*keys, F.col("variable").alias("name"), F.lit(False).alias("call"), "type").unionByName(own), rows, returns)
    return with_types(each, keys, told_.where("NOT call").drop("call"), told_.where("call").drop("call"), members)
