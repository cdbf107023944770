"""Flow of types through module source: blocks, states of variables, return types, dependencies, diagnostics.

A statement may run over several lines; a line has one statement. Block structure comes from one
aggregation over a file's lines: a line's place is the list of blocks around it, each with the
branch it lies in. A variable's assignments and points within its routine are then gathered in one
row, and comparing places settles which reach which.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import analysis as A
from .graph import cut, join_often, substitute, unringed

#: The bilingual words that open, part and close blocks.
OPEN_IF, OPEN_LOOP, OPEN_TRY = r"(?iu)^\s*(?:Если|If)\b.*\b(?:Тогда|Then)\s*$", r"(?iu)^\s*(?:Пока|While|Для|For)\b.*\b(?:Цикл|Do)\s*$", r"(?iu)^\s*(?:Попытка|Try)\s*$"
BRANCH = r"(?iu)^\s*(?:ИначеЕсли|ElsIf|Иначе|Else|Исключение|Except)\b"
BARE_ELSE = r"(?iu)^\s*(?:Иначе|Else)\s*$"
CLOSE = r"(?iu)^\s*(?:КонецЕсли|EndIf|КонецЦикла|EndDo|КонецПопытки|EndTry)\b"
CONDITION = r"(?iu)^\s*(?:Если|If|ИначеЕсли|ElsIf)\b(.*)\b(?:Тогда|Then)\s*$"
#: What every line begins with that opens, parts or closes a block or a routine.
MARKED = r"(?iu)^\s*(?:Если|If|Пока|While|Для|For|Попытка|Try|Иначе|Else|ElsIf|Исключение|Except|Конец|End|Процедура|Функция|Procedure|Function)"
DECLARED = r"(?iu)^\s*(?:Перем|Var)\s+(.+?)\s*;"

NAME = r"[\p{L}_][\p{L}\p{N}_]*"
LITERALS = (*A.KEYWORDS, "истина", "ложь", "true", "false", "неопределено", "undefined", "null")


def _block_step(held: Column, x: Column) -> Column:
    """One statement more: its routine and the blocks around it."""
    now, line, kind = held["now"], x["line"], x["kind"]
    entry = lambda block: F.array(F.struct(block.alias("block"), line.alias("branch")))
    outer = F.slice(now, F.lit(1), F.greatest(F.size(now) - 1, F.lit(0)))
    around = F.when(kind.isin("branch", "close"), outer).otherwise(now)
    inside = F.when(kind == "open", F.concat(now, entry(line))).when((kind == "branch") & (F.size(now) > 0), F.concat(outer, entry(F.get(now, F.size(now) - 1)["block"]))).otherwise(around)
    routine = F.coalesce(x["begins"], held["routine"])
    row = F.struct(line.alias("line"), x["code"].alias("code"), routine.alias("routine"), kind.alias("kind"), around.alias("place"))
    return F.struct(inside.alias("now"), F.when(~x["ends"], routine).alias("routine"), F.concat(held["out"], F.array(row)).alias("out"))


def blocks(files: DataFrame) -> DataFrame:
    """``placed_lines`` as a scratch table, as all that follows reads them several times."""
    return cut(placed_lines(files))


def placed_lines(files: DataFrame) -> DataFrame:
    """Lines (path, line, code, routine) with ``kind`` (open, branch, close or null) and ``place``.

    ``place`` lists the blocks around the line, outermost first: the line that opens a block and
    the line that begins the branch. A line that opens, parts or closes a block has the place of
    the whole block. Routines and the stack of open blocks run along a file's statements in one
    aggregation, however deep they nest; a file is a row until then, so nothing is moved.
    """
    stack = "array<struct<block:int,branch:int>>"

    def told(x: Column) -> Column:
        code = x["code"]
        opens = code.rlike(OPEN_IF) | code.rlike(OPEN_LOOP) | code.rlike(OPEN_TRY)
        kind = F.when(opens, "open").when(code.rlike(BRANCH), "branch").when(code.rlike(CLOSE), "close")
        row = lambda kind, begins, ends: F.struct(x["line"], code.alias("code"), kind.cast("string").alias("kind"), begins.cast("string").alias("begins"), ends.alias("ends"))
        marked = row(kind, F.when(code.rlike(A.HEAD) & code.rlike(A.BEGIN), F.regexp_extract(code, A.BEGIN, 2)), code.rlike(A.END))
        return F.when(code.rlike(MARKED), marked).otherwise(row(F.lit(None), F.lit(None), F.lit(False)))

    start = F.struct(F.array().cast(stack).alias("now"), F.lit(None).cast("string").alias("routine"), F.array().cast(f"array<struct<line:int,code:string,routine:string,kind:string,place:{stack}>>").alias("out"))
    made = F.aggregate(F.transform(A.statement_array(A.line_array(F.col("content"))), told), start, _block_step, lambda s: s["out"])
    return files.select("path", F.explode(made).alias("_l")).select("path", "_l.line", "_l.code", "_l.routine", "_l.kind", "_l.place")


def told(rows: DataFrame) -> DataFrame:
    """``rows`` with what their code says, as they are if they have it: ``variable``, ``value`` and ``given`` (the value's type by
    form) of a plain assignment in a routine, ``back`` and ``returned`` (its type by form) of a return, ``head`` of a routine's first line.

    Where several steps read the same lines, this is done once before they become a scratch table.
    """
    if "returned" in rows.columns:
        return rows
    first = lambda pattern: A.let(F.regexp_extract("code", pattern, 1), lambda found: F.when(found != "", found))
    code, inside = F.col("code"), F.col("routine").isNotNull()
    given = F.filter(F.split(F.regexp_extract(code, A.BEGIN, 3), ","), lambda p: F.trim(p) != "")
    head = F.struct(F.regexp_extract(code, A.BEGIN, 2).alias("routine"), (F.regexp_extract(code, A.BEGIN, 4) != "").alias("exported"), F.size(given).alias("n_parameters"))
    read = rows.withColumns({
        "variable": F.when(inside & F.col("kind").isNull() & code.contains("="), first(A.ASSIGN)), "back": F.when(inside & code.contains(";"), first(A.RETURN)),
        "head": F.when(code.rlike(A.HEAD) & code.rlike(A.BEGIN), head),
    })
    by_form = lambda c: F.when(F.col(c).isNotNull(), A.let(F.trim(c), value_type))
    read = read.withColumn("value", F.when(F.col("variable").isNotNull(), F.regexp_extract("code", A.ASSIGN, 2)))
    return read.withColumns({"given": by_form("value"), "returned": by_form("back")})


def _within(outer: Column, inner: Column) -> Column:
    """Whether one place is the other's beginning."""
    return (F.size(outer) == 0) | ((F.size(outer) <= F.size(inner)) & (F.slice(inner, F.lit(1), F.size(outer)) == outer))


def value_type(text: Column) -> Column:
    """Type of a value by its form: a name or call to resolve, what ``expression_type`` tells, else Unknown."""
    t = F.trim(text)
    plain = lambda pattern: t.rlike(pattern) & ~A.is_word(t, *LITERALS)
    return (
        F.when(plain(rf"(?u)^{NAME}$"), F.concat(F.lit("name:"), t))
        .when(plain(rf"(?u)^{NAME}\s*\([^()]*\)$"), F.concat(F.lit("call:"), F.regexp_extract(t, rf"(?u)^({NAME})", 1)))
        .otherwise(F.coalesce(A.expression_type(t), F.lit("Unknown")))
    )


def assigned(rows: DataFrame) -> DataFrame:
    """path, routine, line, variable, place and type (by form: ``value_type``) of the plain assignments in routines."""
    return told(rows).where("variable IS NOT NULL").select("path", "routine", "line", "variable", "place", F.col("given").alias("type"))


def covers(rows: DataFrame) -> DataFrame:
    """What ``reaching`` needs of the blocks of ``rows``, found once for several calls (``whole``)."""
    return cut(_covers(assigned(rows), rows))


def _covers(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """Blocks whose every branch assigns a variable: what was assigned before them is gone behind them.

    ``placed`` are assignments; found blocks count as assignments of the block around them, level by level.
    """
    inner = F.element_at("place", -1)
    lines_of = rows.where("kind IS NOT NULL").select("path", "line", F.col("code").rlike(BARE_ELSE).alias("_bare"), "kind", "place")
    level = F.size("place")
    known = lines_of.withColumn("_block", F.last(F.when(F.col("kind") == "open", F.col("line")), ignorenulls=True).over(Window.partitionBy("path", level).orderBy("line")))
    shape = known.groupBy("path", "_block").agg(F.sum(F.when(F.col("kind") != "close", 1).otherwise(0)).alias("_branches"), F.max("_bare").alias("_else"), F.max(F.when(F.col("kind") == "close", F.col("line"))).alias("_end"), F.first("place").alias("_outer"))
    shape = cut(shape.where("_else AND _end IS NOT NULL"))
    found = None
    held = placed.select("path", "routine", "variable", "place")
    deepest = placed.agg(F.coalesce(F.max(F.size("place")), F.lit(0))).first()[0]
    for depth in range(deepest, 0, -1):
        at = held.where(F.size("place") == depth).select("path", "routine", "variable", inner["block"].alias("_block"), inner["branch"].alias("_branch"))
        all_of = at.groupBy("path", "routine", "variable", "_block").agg(F.count_distinct("_branch").alias("_n")).join(shape, ["path", "_block"]).where("_n = _branches")
        made = cut(all_of.select("path", "routine", "variable", F.col("_outer").alias("place"), F.col("_block").alias("since"), F.col("_end").alias("at")))
        found = made if found is None else found.unionByName(made)
        held = held.unionByName(made.select("path", "routine", "variable", "place"))
    empty = placed.limit(0).select("path", "routine", "variable", "place", F.col("line").alias("since"), F.col("line").alias("at"))
    return empty if found is None else found


def reaching(rows: DataFrame, placed: DataFrame, points: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """``points`` (path, routine, line, variable, place) with the assignments that reach them: their line and type.

    An assignment doesn't reach a point in another branch of its block, nor one behind a later
    assignment that lies on each way between them. Loops are run once or not at all. A variable's
    assignments, covering blocks and points within its routine are gathered in one row, so they
    move once; ``whole`` is what ``covers`` tells of ``rows``.
    """
    keys = ["path", "routine", "variable"]
    found = lambda df, role, at, since, type_: df.select(*keys, F.struct(F.lit(role).alias("role"), F.col(at).cast("int").alias("at"), F.col(since).cast("int").alias("since"), "place", type_.cast("string").alias("type")).alias("_e"))
    parts = [found(placed, "made", "line", "line", F.col("type")), found(_covers(placed, rows) if whole is None else whole, "whole", "at", "since", F.lit(None)), found(points, "point", "line", "line", F.lit(None))]
    # Paths begin alike, so rows are told apart by a hash first.
    every = reduce(DataFrame.unionByName, parts).dropna(subset=keys).groupBy(F.xxhash64(*keys).alias("_h"), *keys).agg(F.collect_list("_e").alias("_e"))
    of = lambda role: F.filter("_e", lambda e: e["role"] == role)
    met = every.select(*keys, of("made").alias("_made"), of("point").alias("_points"), F.filter("_e", lambda e: e["role"] != "point").alias("_kills")).where("size(_made) > 0 AND size(_points) > 0")

    def reach(p: Column) -> Column:
        def open_(a: Column) -> Column:
            apart = F.exists(p["place"], lambda x: F.exists(a["place"], lambda y: (x["block"] == y["block"]) & (x["branch"] != y["branch"])))
            between = lambda k: (a["at"] < k["since"]) & ((k["at"] < p["at"]) | ((k["role"] == "whole") & (k["at"] == p["at"])))
            gone = F.exists("_kills", lambda k: between(k) & (_within(k["place"], a["place"]) | _within(k["place"], p["place"])))
            return (a["at"] < p["at"]) & ~apart & ~gone

        return F.transform(F.filter("_made", open_), lambda a: F.struct(p["at"].alias("line"), a["at"].alias("at"), a["type"].alias("type")))

    return met.select(*keys, F.inline(F.flatten(F.transform("_points", reach)))).select("path", "routine", "line", "variable", "at", "type")


def held(rows: DataFrame, whole: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """path, routine, line, variable and type: what names hold at the ``points`` (as for ``reaching``), and in values and returned values that are one name.

    A call stands as ``call:name`` (see ``answered``). Which assignments reach a name hangs neither
    on types nor on what calls return, so it is found once for all that ask for it; chains of names
    are followed by doubling. A name that nothing reaches has no row.
    """
    placed, name = assigned(rows), lambda c: F.when(F.col(c).startswith("name:"), F.substring(c, 6, 1 << 20))
    if points is None:
        named = F.filter(F.array(name("given"), name("returned")), lambda n: n.isNotNull())
        points = told(rows).where("routine IS NOT NULL").select("path", "routine", "line", "place", F.explode(F.array_distinct(named)).alias("variable"))
    met = cut(reaching(rows, placed, points, whole))
    is_name = F.col("type").startswith("name:")
    linked = met.where(is_name)
    if linked.isEmpty():
        return met.drop("at")
    # Only names that hold what another name brings are followed, through the assignments of that name.
    node = lambda *cs: F.concat_ws("\u0000", *cs)
    brought = met.select(node("path", "line", "variable").alias("node"), F.when(~is_name, F.col("type")).alias("type"), F.when(is_name, node("path", "at", name("type"))).alias("to"), F.lit(True).alias("_r")).distinct()
    far = linked.select(node("path", "at", name("type")).alias("node")).distinct().join(brought, "node", "left")
    found = substitute(far.select("node", F.when(F.col("_r").isNull(), "Unknown").otherwise(F.col("type")).alias("type"), "to", F.lit(1.0).alias("weight"))).select(F.col("node").alias("_node"), F.col("type").alias("_type")).distinct()
    settled = linked.withColumn("_node", node("path", "at", name("type"))).join(found, "_node").select("path", "routine", "line", "variable", F.col("_type").alias("type"))
    return met.where(~is_name).drop("at").unionByName(cut(settled))


def answered(typed: DataFrame, rows: DataFrame, returns: DataFrame | None) -> DataFrame:
    """``typed`` (path, type, ...) with the types that its calls (``call:name``) return by ``returns`` (path, routine, type), a row for each; Unknown where none is told.

    Which routine a call means is asked once for each name of a file. ``typed`` is read three times.
    """
    is_call = F.col("type").startswith("call:")
    if returns is None:
        return typed.withColumn("type", F.when(is_call, "Unknown").otherwise(F.col("type")))
    calls = typed.where(is_call).withColumn("callee", F.substring("type", 6, 1 << 20))
    asked = cut(find_callees(cut(calls.select("path", "callee").distinct()), declared(rows)))
    back = returns.select(F.col("path").alias("callee_path"), F.col("routine").alias("callee"), "type").groupBy("callee_path", "callee").agg(F.collect_set("type").alias("_types"))
    types = join_often(asked.where("callee_path IS NOT NULL"), back, ["callee_path", "callee"]).select("path", "callee", "_types")
    met = calls.join(types, ["path", "callee"], "left").withColumn("type", F.explode(F.coalesce("_types", F.array(F.lit("Unknown")))))
    return typed.where(~is_call).unionByName(met.select(*typed.columns))


def declared(rows: DataFrame) -> DataFrame:
    """path, routine, exported and n_parameters of all routines of ``rows`` (lines)."""
    return told(rows).where("head IS NOT NULL").select("path", "head.routine", "head.exported", "head.n_parameters")


def find_callees(calls: DataFrame, routines: DataFrame) -> DataFrame:
    """``calls`` (path, callee, ...) with callee_path: the file whose routine is meant.

    That is the caller's own file if it has one of that name, else the only file that exports one;
    null if none does, or several do. ``routines`` are rows of ``declared``.
    """
    own = routines.select("path", F.col("routine").alias("callee"), F.col("path").alias("_own")).distinct()
    away = routines.where("exported").groupBy(F.col("routine").alias("callee")).agg(F.min("path").alias("_a"), F.max("path").alias("_b")).where("_a = _b").drop("_b")
    named = join_often(calls.where("callee IS NOT NULL"), away, ["callee"], "left").join(own, ["path", "callee"], "left")
    return named.withColumn("callee_path", F.coalesce("_own", "_a")).drop("_own", "_a").unionByName(calls.where("callee IS NULL").withColumn("callee_path", F.lit(None).cast("string")))


def typed_assignments(rows: DataFrame, returns: DataFrame | None = None, whole: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Assignments in routines: path, routine, line, variable, place and type; a row for each type that a name brings.

    Names take the types that reach them where they stand (``names`` of ``held``, if found before),
    calls those of ``returns`` (path, routine, type).
    """
    placed = assigned(rows)
    is_name = F.col("type").startswith("name:")
    brought = (held(rows, whole) if names is None else names).select("path", "routine", "line", F.col("variable").alias("_name"), F.col("type").alias("_type"))
    named = placed.where(is_name).withColumn("_name", F.substring("type", 6, 1 << 20)).join(brought, ["path", "routine", "line", "_name"], "left")
    settled = named.select(*[F.coalesce("_type", F.lit("Unknown")).alias(c) if c == "type" else c for c in placed.columns], F.lit(True).alias("_named"))
    made = cut(answered(cut(placed.where(~is_name).withColumn("_named", F.lit(False)).unionByName(settled)), rows, returns))
    return made.where("NOT _named").unionByName(made.where("_named").distinct()).drop("_named")


def states(rows: DataFrame, placed: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """path, routine, line, variable, type and weight: what variables hold where a block or routine ends.

    Every assignment that reaches the point weighs alike, and its types share that weight.
    """
    ends = rows.where("routine IS NOT NULL AND (kind = 'close')").select("path", "routine", "line", "place")
    last = rows.where("routine IS NOT NULL").groupBy("path", "routine").agg(F.max_by("place", "line").alias("place"), (F.max("line") + 1).alias("line")).select("path", "routine", "line", "place")
    points = ends.unionByName(last).join(placed.select("path", "routine", "variable").distinct(), ["path", "routine"])
    met = reaching(rows, placed, points, whole)
    here = ["path", "routine", "line", "variable"]
    sized = met.withColumn("_own", 1 / F.count(F.lit(1)).over(Window.partitionBy(*here, "at")))
    summed = sized.groupBy(*here, "type").agg(F.sum("_own").alias("_w"))
    return summed.withColumn("weight", F.col("_w") / F.sum("_w").over(Window.partitionBy(*here))).drop("_w")


def direct_returns(rows: DataFrame, placed: DataFrame | None = None, whole: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """path, routine, type (or call:name) and weight of each routine's own returns; Void for one without. Loops aren't looked into.

    What names hold is told by ``names`` (of ``held``), or by the assignments ``placed`` that reach them.
    """
    loop = rows.where(F.col("kind") == "open").where(F.col("code").rlike(OPEN_LOOP)).select("path", F.col("line").alias("_loop")).groupBy("path").agg(F.collect_set("_loop").alias("_loops"))
    body = told(rows).where("returned IS NOT NULL").select("path", "routine", "line", "place", F.col("returned").alias("type")).join(loop, "path", "left")
    typed = cut(body.where(~F.coalesce(F.exists("place", lambda p: F.array_contains("_loops", p["block"])), F.lit(False))).drop("_loops"))
    points = typed.where(F.col("type").startswith("name:")).select("path", "routine", "line", F.substring("type", 6, 1 << 20).alias("variable"), "place")
    here = ["path", "routine", "line", "variable"]
    reached = reaching(rows, placed, points, whole) if names is None else answered(points.select(*here).join(names, here), rows, None)
    met = reached.select("path", "routine", "line", F.col("type").alias("_new")).distinct()
    each = typed.join(met, ["path", "routine", "line"], "left").withColumn("type", F.when(F.col("type").startswith("name:"), F.coalesce("_new", F.lit("Unknown"))).otherwise(F.col("type")))
    share = 1 / (F.count(F.lit(1)).over(Window.partitionBy("path", "routine", "line")) * F.size(F.collect_set("line").over(Window.partitionBy("path", "routine"))))
    summed = each.withColumn("_w", share).groupBy("path", "routine", "type").agg(F.sum("_w").alias("weight"))
    void = declared(rows).select("path", "routine").distinct().join(summed.select("path", "routine"), ["path", "routine"], "left_anti")
    return summed.unionByName(void.select("path", "routine", F.lit("Void").alias("type"), F.lit(1.0).alias("weight")))


def return_types(direct: DataFrame, routines: DataFrame) -> DataFrame:
    """path, routine, type and weight with calls followed into the routines they mean (``find_callees``).

    Routines are told by file and name. Weights are merged at each routine, so that any number of
    ways through the calls is one row a type; a chain of n calls takes log2(n) joins. Recursion: a
    call of another routine of the same ring brings that routine's types, in which calls into the
    ring are Unknown; a call of itself is Unknown, and so is one that no file or several files answer.
    """
    called = F.col("type").startswith("call:")
    told = find_callees(direct.withColumn("callee", F.when(called, F.substring("type", 6, 1 << 20))), routines)
    node = lambda path, name: F.concat_ws("\u0000", path, name)
    lost = called & F.col("callee_path").isNull()
    rows = told.select(node("path", "routine").alias("node"), F.when(lost, "Unknown").when(~called, F.col("type")).alias("type"), F.when(called & ~lost, node("callee_path", "callee")).alias("to"), "weight")
    found = substitute(unringed(cut(rows.groupBy("node", "type", "to").agg(F.sum("weight").alias("weight")))))
    parts = F.split("node", "\u0000")
    return found.where(~F.col("node").endswith("\u0001")).select(parts[0].alias("path"), parts[1].alias("routine"), "type", "weight")


def call_graph(rows: DataFrame) -> DataFrame:
    """caller_path, caller, callee_path, callee, calls and way: calls from each routine, as they are (out) and reversed (in).

    callee_path is the file that ``find_callees`` tells, null for a name that no file or several files answer.
    """
    body = rows.where(F.col("routine").isNotNull() & ~F.col("code").rlike(A.BEGIN))
    plain = F.regexp_replace("code", r'"(?:[^"]|"")*"', '""')
    each = body.select("path", F.col("routine").alias("caller"), F.explode(F.regexp_extract_all(plain, F.lit(A.CALL), F.lit(1))).alias("callee")).where(~F.lower("callee").isin(*A.KEYWORDS, "type", "тип", "typeof", "типзнч"))
    counted = each.groupBy("path", "caller", "callee").agg(F.count(F.lit(1)).alias("calls"))
    out = find_callees(counted, declared(rows)).select(F.col("path").alias("caller_path"), "caller", "callee_path", "callee", "calls")
    back = out.select(F.col("callee_path").alias("caller_path"), F.col("callee").alias("caller"), F.col("caller_path").alias("callee_path"), F.col("caller").alias("callee"), "calls", F.lit("in").alias("way"))
    return out.withColumn("way", F.lit("out")).unionByName(back)


def dependencies(rows: DataFrame) -> DataFrame:
    """path, src, dst and kind: what a variable, parameter or routine depends on.

    Kinds: assignment (a value that is one name), expression (names and calls in a longer one),
    field and method (of an object), parameter (what a call's argument names), return, and
    conditional (names in the condition of the branch that an assignment lies in).
    """
    bare = F.regexp_replace("code", r'"(?:[^"]|"")*"', '""')
    body = rows.where(F.col("routine").isNotNull() & F.col("kind").isNull() & ~F.col("code").rlike(A.BEGIN)).withColumn("_code", bare)
    made = body.where(F.col("_code").rlike(A.ASSIGN)).select("path", "place", F.regexp_extract("_code", A.ASSIGN, 1).alias("src"), F.trim(F.regexp_extract("_code", A.ASSIGN, 2)).alias("value"))
    back = body.where(F.col("_code").rlike(A.RETURN)).select("path", F.concat("routine", F.lit("()")).alias("src"), F.trim(F.regexp_extract("_code", A.RETURN, 1)).alias("value"))
    names = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(rf"(?u)(?<![\p{{L}}\p{{N}}_.])({NAME})(?![\p{{L}}\p{{N}}_]|\s*[(.])"), F.lit(1)), lambda n: ~F.lower(n).isin(*LITERALS)))
    found = lambda t, pattern: F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))
    one = F.col("value").rlike(rf"(?u)^{NAME}$")
    row = lambda df, dst, kind: df.select("path", "src", F.explode(dst).alias("dst"), kind.alias("kind"))
    member = rf"(?u)(?<![\p{{L}}\p{{N}}_.])({NAME}\.{NAME})"
    calls = F.transform(F.filter(found("value", A.CALL), lambda n: ~F.lower(n).isin(*LITERALS)), lambda n: F.concat(n, F.lit("()")))
    parts = [
        row(made, names(F.col("value")), F.when(one, "assignment").otherwise("expression")),
        row(made, calls, F.lit("expression")),
        row(made, found("value", member + rf"(?![\p{{L}}\p{{N}}_]|\s*\()"), F.lit("field")),
        row(made, found("value", member + r"\s*\("), F.lit("method")),
        row(back, F.concat(names(F.col("value")), calls), F.lit("return")),
    ]
    texts = F.regexp_extract_all("_code", F.lit(rf"(?u)(?<![\p{{L}}\p{{N}}_.])({NAME}\s*\([^()]*\))"), F.lit(1))
    given = body.select("path", F.explode(texts).alias("_c")).select("path", F.trim(F.regexp_extract("_c", r"^([^(]*)", 1)).alias("_f"), F.posexplode(F.split(F.regexp_extract("_c", r"\((.*)\)$", 1), ",")).alias("_i", "value")).where(~F.lower("_f").isin(*LITERALS))
    parts.append(row(given.withColumn("src", F.concat("_f", F.lit("."), "_i")), names(F.col("value")), F.lit("parameter")))
    asked = rows.where(F.col("code").rlike(CONDITION)).select("path", F.col("line").alias("_branch"), names(F.regexp_extract(bare, CONDITION, 1)).alias("_names"))
    under = made.select("path", "src", F.explode("place").alias("_p")).select("path", "src", F.col("_p.branch").alias("_branch")).join(asked, ["path", "_branch"])
    parts.append(row(under, F.col("_names"), F.lit("conditional")))
    return reduce(DataFrame.unionByName, parts).distinct()


def undeclared(rows: DataFrame) -> DataFrame:
    """path, line, severity and message: names that are read but neither declared, nor parameters, nor assigned before in their routine."""
    body = rows.where(F.col("routine").isNotNull() & ~F.col("code").rlike(A.BEGIN))
    bare = F.regexp_replace(F.when(F.col("code").rlike(A.ASSIGN) & F.col("kind").isNull(), F.regexp_extract("code", A.ASSIGN, 2)).otherwise(F.regexp_replace("code", r"(?iu)^\s*(Если|If|ИначеЕсли|ElsIf|Пока|While|Возврат|Return)\b|\b(Тогда|Then|Цикл|Do)\s*$", "")), r'"(?:[^"]|"")*"', '""')
    read = F.array_distinct(F.filter(F.regexp_extract_all(bare, F.lit(rf"(?u)(?<![\p{{L}}\p{{N}}_.])({NAME})(?![\p{{L}}\p{{N}}_]|\s*\()"), F.lit(1)), lambda n: ~F.lower(n).isin(*LITERALS, "else", "иначе", "try", "except", "endif", "enddo", "endtry", "endfunction", "endprocedure", "конецесли", "конеццикла", "конецпопытки", "конецфункции", "конецпроцедуры", "попытка", "исключение", "new", "новый")))
    uses = body.select("path", "routine", "line", F.explode(read).alias("name"))
    text = F.regexp_extract("code", A.BEGIN, 3)
    given = rows.where(F.col("code").rlike(A.BEGIN)).select("path", F.regexp_extract("code", A.BEGIN, 2).alias("routine"), F.explode(F.transform(F.split(text, ","), lambda p: F.trim(F.regexp_replace(p, r"(?iu)^\s*(Знач|Val)\s+|=.*$", "")))).alias("name"), F.lit(0).alias("since"))
    own = rows.where(F.col("routine").isNotNull() & F.col("kind").isNull() & F.col("code").rlike(A.ASSIGN)).groupBy("path", "routine", F.regexp_extract("code", A.ASSIGN, 1).alias("name")).agg(F.min("line").alias("since"))
    known = given.unionByName(own).groupBy("path", "routine", "name").agg(F.min("since").alias("since"))
    wide = rows.where(F.col("code").rlike(DECLARED)).select("path", F.explode(F.split(F.regexp_extract("code", DECLARED, 1), r"\s*,\s*")).alias("name")).distinct()
    left = uses.join(wide, ["path", "name"], "left_anti").join(known, ["path", "routine", "name"], "left").where("since IS NULL OR since >= line")
    return left.select("path", "line", F.lit("warning").alias("severity"), F.format_string("%s is not declared", "name").alias("message"))


def wrong_operators(rows: DataFrame) -> DataFrame:
    """path, line, severity and message: texts and truth values under -, * or /."""
    value = F.when(F.col("code").rlike(A.ASSIGN) & F.col("kind").isNull(), F.regexp_extract("code", A.ASSIGN, 2))
    odd = r"""(?iu)(?:"(?:[^"]|"")*"|\b(?:true|false|истина|ложь)\b)\s*([-*/])|([-*/])\s*(?:"(?:[^"]|"")*"|\b(?:true|false|истина|ложь)\b)"""
    found = rows.where("routine IS NOT NULL").select("path", "line", value.alias("_v")).where(F.col("_v").rlike(odd))
    sign = F.concat(F.regexp_extract("_v", odd, 1), F.regexp_extract("_v", odd, 2))
    return found.select("path", "line", F.lit("warning").alias("severity"), F.format_string("%s takes numbers", sign).alias("message"))


def arity(files: DataFrame) -> DataFrame:
    """``wrong_counts`` of files."""
    return wrong_counts(blocks(files))


def wrong_counts(rows: DataFrame) -> DataFrame:
    """path, line, severity and message: calls with more arguments than the routine takes that is meant (``find_callees``)."""
    routines = declared(rows)
    body = rows.where(F.col("routine").isNotNull() & ~F.col("code").rlike(A.BEGIN))
    plain = F.regexp_replace("code", r'"(?:[^"]|"")*"', '""')
    inner = F.regexp_extract_all(plain, F.lit(rf"(?u)(?<![\p{{L}}\p{{N}}_.])({NAME}\s*\([^()]*\))"), F.lit(1))
    calls = body.select("path", "line", F.explode(inner).alias("c")).select("path", "line", F.trim(F.regexp_extract("c", r"^([^(]*)\(", 1)).alias("callee"), F.trim(F.regexp_extract("c", r"\((.*)\)$", 1)).alias("args"))
    given = F.when(F.col("args") == "", 0).otherwise(F.size(F.split("args", ",")))
    takes = routines.select(F.col("path").alias("callee_path"), F.col("routine").alias("callee"), F.col("n_parameters").alias("n"))
    met = find_callees(calls.withColumn("given", given), routines).join(takes, ["callee_path", "callee"])
    return met.where("given > n").select("path", "line", F.lit("error").alias("severity"), F.format_string("%s takes %d arguments, not %d", "callee", "n", "given").alias("message"))
