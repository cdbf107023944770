"""Types through module source made of ``part``: a file for each part, whose shape hangs on the part, and one that all call."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.operators import flow as W
from quarry.operators import graph as G
from quarry.sources.registry import Registry

from .base import query

_COMMON = "Function Common(a, b) Export\n    Return '20240101';\nEndFunction\n"


def _files(spark, d):
    """Branches, returns, calls and mistakes by the remainders of the part's size; the number of lines is always the same. Each file has its own Kind."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    by = lambda n, *texts: F.element_at(F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts]), (s % n + 1).cast("int"))
    size = s.cast("string")
    lines = [
        F.lit("Var total;"),
        F.concat(F.lit("Function Price"), k, F.lit("(a, b = 1)"), by(3, " Export", "", "")),
        F.concat(F.lit("    x = "), size, F.lit("; // first")),
        F.lit("    y = x;"),
        F.concat(F.lit("    If a > "), size, F.lit(" Then")),
        F.lit('        x = "big // not a comment";'),
        by(2, "        Return x;", "        z = x;"),
        by(4, '    ElsIf TypeOf(a) = Type("String") Then', *["    ElsIf a = Undefined Then"] * 3),
        F.lit("        x = True;"),
        by(5, "    // no else", *["    Else"] * 4),
        by(5, "    // no call", *["        x = Common(a, b);"] * 4),
        F.lit("    EndIf;"),
        F.lit("    While b < 10 Do"),
        F.concat(F.lit("        b = b + Step"), (s % 7).cast("string"), F.lit("(x);")),
        F.lit("        x = '20240101';"),
        F.lit("    EndDo;"),
        F.concat(F.lit("    Return "), by(3, F.concat(F.lit("Price"), (F.col("p_partkey") + 1).cast("string"), F.lit("(b)")), size, "Kind()"), F.lit(";")),
        F.lit("EndFunction"),
        F.concat(F.lit("Procedure Run"), k, F.lit("()")),
        by(5, "    Common(1, 2);", "    Common(1, 2, 3);", *["    Common(1, 2);"] * 3),
        F.lit("    w = q + 1;"),
        F.lit("    u = total.Find(w);"),
        F.lit("    t = total.Name;"),
        by(6, '    v = "a" * 2;', *["    v = w;"] * 5),
        F.lit("EndProcedure"),
        F.lit("Function Kind() Export"),
        by(2, '    Return "text";', "    Return 1;"),
        F.lit("EndFunction"),
    ]
    # Files are a hundred times the size of their rows, so the rows are dealt to all cores first.
    table = Registry(spark, d).table("part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    part = table.select(F.concat(F.lit("/parts/"), k, F.lit(".bsl")).alias("path"), F.array_join(F.array(*lines), "\n").alias("content"))
    return part.unionByName(spark.createDataFrame([("/common.bsl", _COMMON)], "path string, content string"))


_P = "'/parts/' || p_partkey || '.bsl' AS path"
_F = "'Price' || p_partkey"
_RUN = "'Run' || p_partkey"


@query("code_blocks", f"SELECT {_P}, v.line, v.places, v.kind FROM part, (VALUES (5, '', 'open'), (6, '5/5', NULL), (7, '5/5', NULL), (8, '', 'branch'), (9, '5/8', NULL), (10, '', 'branch'), (11, '5/10', NULL), (12, '', 'close'), (13, '', 'open'), (14, '13/13', NULL), (15, '13/13', NULL), (16, '', 'close')) v(line, places, kind) WHERE p_size % 5 <> 0 OR v.line NOT IN (10, 11) UNION ALL SELECT {_P}, l, '5/8', NULL FROM part, (VALUES (10), (11)) v(l) WHERE p_size % 5 = 0")
def code_blocks(spark, d):
    rows = W.blocks(_files(spark, d)).where("kind IS NOT NULL OR size(place) > 0")
    return rows.select("path", "line", F.array_join(F.transform("place", lambda p: F.concat(p["block"].cast("string"), F.lit("/"), p["branch"].cast("string"))), ",").alias("places"), "kind")


_DIRECT = f"""SELECT p_partkey AS k, {_F} AS routine, 'String' AS type, 0.5 AS w, CAST(NULL AS BIGINT) AS next FROM part WHERE p_size % 2 = 0
 UNION ALL SELECT p_partkey, {_F}, CASE p_size % 3 WHEN 1 THEN 'Number' WHEN 2 THEN CASE p_size % 2 WHEN 0 THEN 'String' ELSE 'Number' END END, CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 1.0 END, CASE WHEN p_size % 3 = 0 THEN p_partkey + 1 END FROM part"""

_RETURNS = f"""WITH RECURSIVE d AS ({_DIRECT}), x AS (SELECT p_partkey AS k FROM part WHERE p_size % 3 = 0),
 w AS (SELECT k, routine, type, CAST(w AS DOUBLE) AS w, next FROM d
  UNION ALL SELECT w.k, w.routine, CASE WHEN x.k IS NULL THEN 'Unknown' ELSE d.type END, w.w * coalesce(d.w, 1), d.next FROM w LEFT JOIN x ON x.k = w.next LEFT JOIN d ON d.k = x.k WHERE w.next IS NOT NULL)
 SELECT '/parts/' || k || '.bsl' AS path, routine, type, round(sum(w), 6) AS weight FROM w WHERE type IS NOT NULL GROUP BY k, routine, type
 UNION ALL SELECT {_P}, {_RUN}, 'Void', 1.0 FROM part UNION ALL SELECT {_P}, 'Kind', CASE p_size % 2 WHEN 0 THEN 'String' ELSE 'Number' END, 1.0 FROM part UNION ALL SELECT '/common.bsl', 'Common', 'Date', 1.0"""


def _held(rows, points=None):
    """What covers assignments in ``rows``, what names hold, and return types."""
    whole = W.covers(rows)
    names = W.held(rows, whole, points)
    return whole, names, W.return_types(W.direct_returns(rows, names=names), W.declared(rows))


def _typed(spark, d):
    """Lines of all files, what covers assignments in them, and typed assignments."""
    rows = G.cut(W.told(W.placed_lines(_files(spark, d))))
    whole, names, returns = _held(rows)
    return rows, whole, W.typed_assignments(rows, returns, names=names)


@query("ret_types_across", _RETURNS)
def ret_types_across(spark, d):
    """Weighted return types, through calls into other files; files that have routines of one name keep their own."""
    return _held(G.cut(W.told(W.placed_lines(_files(spark, d)))))[2].select("path", "routine", "type", F.round("weight", 6).alias("weight"))


_STATES = f"""WITH x AS (SELECT {_P}, {_F} AS routine, p_size AS s FROM part),
 p12 AS (SELECT path, routine, s, 'x' AS variable, unnest(CASE WHEN s % 5 = 0 THEN ['Number', 'String', 'Boolean'] ELSE ['String', 'Boolean', 'Date'] END) AS type FROM x),
 late AS (SELECT path, routine, variable, type, l.line FROM (SELECT * FROM p12 UNION ALL SELECT path, routine, s, 'x', 'Date' FROM x), (VALUES (16), (19)) l(line)),
 every AS (SELECT path, routine, 12 AS line, variable, type FROM p12 UNION ALL SELECT path, routine, line, variable, type FROM late
  UNION ALL SELECT path, routine, line, 'y', 'Number' FROM x, (VALUES (12), (16), (19)) l(line)
  UNION ALL SELECT path, routine, line, 'z', 'String' FROM x, (VALUES (12), (16), (19)) l(line) WHERE s % 2 = 1
  UNION ALL SELECT path, routine, line, 'b', 'Unknown' FROM x, (VALUES (16), (19)) l(line)
  UNION ALL SELECT {_P}, {_RUN}, 26, v, 'Unknown' FROM part, (VALUES ('w'), ('u'), ('t'), ('v')) v(v))
 SELECT path, routine, line, variable, type, round(count(*) / sum(count(*)) OVER (PARTITION BY path, line, variable), 6) AS weight FROM every GROUP BY path, routine, line, variable, type"""


@query("flow_states", _STATES)
def flow_states(spark, d):
    """What variables hold where blocks and routines end: branches merged, covered assignments gone, names and calls followed."""
    rows, whole, placed = _typed(spark, d)
    return W.states(rows, placed, whole).select("path", "routine", "line", "variable", "type", F.round("weight", 6).alias("weight"))


#: Only parts whose size is divisible by three export their price.
_CALLS = f"""SELECT caller_path, caller, callee_path, callee, count(*) AS calls FROM (SELECT '/parts/' || p_partkey || '.bsl' AS caller_path, * FROM (
 SELECT p_partkey, {_F} AS caller, '/common.bsl' AS callee_path, 'Common' AS callee FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_partkey, {_F}, NULL, 'Step' || p_size % 7 FROM part
 UNION ALL SELECT a.p_partkey, 'Price' || a.p_partkey, '/parts/' || b.p_partkey || '.bsl', 'Price' || (a.p_partkey + 1) FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 AND b.p_size % 3 = 0 WHERE a.p_size % 3 = 0
 UNION ALL SELECT p_partkey, {_F}, '/parts/' || p_partkey || '.bsl', 'Kind' FROM part WHERE p_size % 3 = 2
 UNION ALL SELECT p_partkey, {_RUN}, '/common.bsl', 'Common' FROM part)) GROUP BY ALL"""


@query("call_graph", f"SELECT caller_path, caller, callee_path, callee, calls, 'out' AS way FROM ({_CALLS}) UNION ALL SELECT callee_path, callee, caller_path, caller, calls, 'in' FROM ({_CALLS})")
def call_graph(spark, d):
    """Calls of all files, as they are and reversed; one routine is called by all."""
    return W.call_graph(W.blocks(_files(spark, d)))


@query("dep_edges_kinds", f"""SELECT DISTINCT path, src, dst, kind FROM (
 SELECT {_P}, 'y' AS src, 'x' AS dst, 'assignment' AS kind FROM part UNION ALL SELECT {_P}, 'z', 'x', 'assignment' FROM part WHERE p_size % 2 = 1
 UNION ALL SELECT {_P}, {_F} || '()', 'x', 'return' FROM part WHERE p_size % 2 = 0
 UNION ALL SELECT {_P}, v.src, v.dst, v.kind FROM part, (VALUES ('x', 'a', 'expression'), ('x', 'b', 'expression'), ('x', 'Common()', 'expression'), ('Common.0', 'a', 'parameter'), ('Common.1', 'b', 'parameter')) v(src, dst, kind) WHERE p_size % 5 <> 0
 UNION ALL SELECT {_P}, v.src, v.dst, v.kind FROM part, (VALUES ('b', 'b', 'expression'), ('b', 'x', 'expression'), ('w', 'q', 'expression'), ('u', 'w', 'expression'), ('u', 'total.Find', 'method'), ('t', 'total.Name', 'field'), ('x', 'a', 'conditional')) v(src, dst, kind)
 UNION ALL SELECT {_P}, 'b', 'Step' || p_size % 7 || '()', 'expression' FROM part UNION ALL SELECT {_P}, 'Step' || p_size % 7 || '.0', 'x', 'parameter' FROM part
 UNION ALL SELECT {_P}, {_F} || '()', 'b', 'return' FROM part WHERE p_size % 3 = 0 UNION ALL SELECT {_P}, {_F} || '()', 'Price' || (p_partkey + 1) || '()', 'return' FROM part WHERE p_size % 3 = 0
 UNION ALL SELECT {_P}, 'Price' || (p_partkey + 1) || '.0', 'b', 'parameter' FROM part WHERE p_size % 3 = 0
 UNION ALL SELECT {_P}, {_F} || '()', 'Kind()', 'return' FROM part WHERE p_size % 3 = 2
 UNION ALL SELECT {_P}, 'v', 'w', 'assignment' FROM part WHERE p_size % 6 <> 0 UNION ALL SELECT {_P}, 'z', 'a', 'conditional' FROM part WHERE p_size % 2 = 1)""")
def dep_edges_kinds(spark, d):
    return W.dependencies(W.blocks(_files(spark, d)))


@query("module_diagnostics", f"SELECT {_P}, 21 AS line, 'warning' AS severity, 'q is not declared' AS message FROM part UNION ALL SELECT {_P}, 24, 'warning', '* takes numbers' FROM part WHERE p_size % 6 = 0 UNION ALL SELECT {_P}, 20, 'error', 'Common takes 2 arguments, not 3' FROM part WHERE p_size % 5 = 1")
def module_diagnostics(spark, d):
    """Undeclared names, operators that don't fit, and calls with too many arguments of a routine of another file."""
    rows = W.blocks(_files(spark, d))
    return W.undeclared(rows).unionByName(W.wrong_operators(rows)).unionByName(W.wrong_counts(rows))


@query("code_action", f"SELECT {_P}, 21 AS line, 'declare' AS action FROM part UNION ALL SELECT {_P}, 24, 'convert the value' FROM part WHERE p_size % 6 = 0 UNION ALL SELECT {_P}, 20, 'fix the call' FROM part WHERE p_size % 5 = 1")
def code_action(spark, d):
    """What to offer for each diagnostic of all files."""
    return module_diagnostics(spark, d).select("path", "line", A.code_action(F.col("message")).alias("action"))


@query("assigned_types", f"""SELECT {_P}, {_F} AS routine, l.line, l.variable, l.type FROM part, (VALUES (3, 'x', 'Number', 0), (4, 'y', 'Number', 0), (6, 'x', 'String', 0), (7, 'z', 'String', 2), (9, 'x', 'Boolean', 0), (11, 'x', 'Date', 5), (14, 'b', 'Unknown', 0), (15, 'x', 'Date', 0)) l(line, variable, type, rule) WHERE l.rule = 0 OR p_size % l.rule <> 0
 UNION ALL SELECT {_P}, {_RUN}, l.line, l.variable, 'Unknown' FROM part, (VALUES (21, 'w'), (22, 'u'), (23, 't'), (24, 'v')) l(line, variable)""")
def assigned_types(spark, d):
    """The type of each assignment of all files: by form, by the name that it copies, by the routine that it calls."""
    return _typed(spark, d)[2].select("path", "routine", "line", "variable", "type")


@query("call_levels", f"WITH RECURSIVE e AS (SELECT coalesce(caller_path, '') || '#' || caller AS caller, coalesce(callee_path, '') || '#' || callee AS callee FROM ({_CALLS})), n AS (SELECT caller AS node FROM e UNION SELECT callee FROM e), w AS (SELECT node, 0 AS level FROM n UNION SELECT e.caller, w.level + 1 FROM w JOIN e ON e.callee = w.node) SELECT node, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY node")
def call_levels(spark, d):
    """Callees before callers, over all files."""
    out = W.call_graph(W.blocks(_files(spark, d))).where("way = 'out'")
    named = lambda side: F.concat(F.coalesce(f"{side}_path", F.lit("")), F.lit("#"), side)
    return G.levels(out.select(named("callee").alias("src"), named("caller").alias("dst")))


_TYPES = [(r, e) for r, e in zip(list(A.CHECKED_TYPES)[::2], list(A.CHECKED_TYPES)[1::2], strict=True)]


@query("refinements", "SELECT p_partkey, CASE WHEN p_size % 9 = 8 OR p_size % 9 = 7 THEN NULL ELSE 'v' || p_size END AS variable, CASE p_size % 9 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN 'Undefined' WHEN 4 THEN 'Null' WHEN 6 THEN 'Boolean' END AS type, CASE p_size % 9 WHEN 0 THEN 'type is' WHEN 1 THEN 'type is not' WHEN 2 THEN 'equals Undefined' WHEN 3 THEN 'not equals Undefined' WHEN 4 THEN 'equals Null' WHEN 5 THEN 'truthy' WHEN 6 THEN 'falsy' END AS kind FROM (SELECT *, ['String', 'Number', 'Boolean', 'Date', 'Array', 'Map', 'Structure', 'ValueTable'][p_partkey % 8 + 1] AS t FROM part)")
def refinements(spark, d):
    """Conditions in both spellings, a type name that says nothing, and comparisons that narrow nothing."""
    k, s = F.col("p_partkey"), F.col("p_size")
    v = F.concat(F.lit("v"), s.cast("string"))
    named = F.element_at(F.array(*[F.when(k % 2 == 0, r).otherwise(e) for r, e in _TYPES]), (k % 8 + 1).cast("int"))
    russian = k % 3 == 0
    check = lambda sign: F.concat(F.when(russian, "ТипЗнч(").otherwise("TypeOf("), v, F.lit(f") {sign} "), F.when(russian, "Тип").otherwise("Type"), F.lit('("'), named, F.lit('")'))
    none = F.when(russian, "Неопределено").otherwise("Undefined")
    forms = [check("="), check("<>"), F.concat(v, F.lit(" = "), none), F.concat(v, F.lit(" <> "), none), F.concat(v, F.lit(" = Null")), v, F.concat(F.when(russian, "НЕ ").otherwise("NOT "), v), F.concat(v, F.lit(" > 1")), F.concat(F.lit("TypeOf("), v, F.lit(') = Type("Form")'))]
    part = Registry(spark, d).table("part").select("p_partkey", A.refinement(F.element_at(F.array(*forms), (s % 9 + 1).cast("int"))).alias("r"))
    return part.select("p_partkey", "r.variable", "r.type", "r.kind")


@query("facet_context", "SELECT p_partkey, CASE WHEN p_type LIKE '%A%' THEN CASE WHEN p_size % 2 = 0 THEN 'Manager' ELSE 'Metadata' END WHEN p_size % 5 = 0 THEN 'Object' ELSE 'Reference' END AS facet, CASE WHEN p_size > 20 THEN CASE WHEN p_type LIKE '%A%' THEN CASE WHEN p_size % 2 = 0 THEN 'Manager' ELSE 'Metadata' END WHEN p_size % 5 = 0 THEN 'Object' ELSE 'Reference' END ELSE 'Collection' END AS switched FROM part")
def facet_context(spark, d):
    """The facet by parent and method, and the switch to it where the type has it."""
    s = F.col("p_size")
    parent = F.concat("p_brand", F.when(F.col("p_type").contains("A"), F.when(s % 2 == 0, F.when(s % 4 == 0, ".Catalogs").otherwise(".Справочники")).otherwise(F.when(s % 3 == 0, ".Metadata").otherwise(".Метаданные"))).otherwise(""))
    method = F.when(s % 10 == 0, "CreateItem").when(s % 5 == 0, "СоздатьЭлемент").when(s % 5 == 1, "FindByCode").otherwise("Other")
    facet = A.facet_of(parent, method)
    available = F.when(s > 20, F.array(*map(F.lit, ("Manager", "Metadata", "Object", "Reference")))).otherwise(F.array(F.lit("Collection")))
    return Registry(spark, d).table("part").select("p_partkey", facet.alias("facet"), A.switch_facet(F.lit("Collection"), facet, available).alias("switched"))


@query("contract_modes", """SELECT p_partkey, m AS mode, CASE WHEN t IS NULL OR p_size < 25 THEN CASE m
 WHEN 'warning' THEN '// ' || v || ': ' || coalesce(t, 'any type') || ' is not certain'
 WHEN 'assert' THEN CASE WHEN t IS NULL THEN 'If NOT ValueIsFilled(' || v || ') Then Raise "' || v || ' is empty"; EndIf;' ELSE 'If TypeOf(' || v || ') <> Type("' || t || '") Then Raise "' || v || ': ' || t || ' expected"; EndIf;' END
 ELSE 'WriteLogEvent("Types", , , "' || coalesce(t, 'any type') || ': " + String(TypeOf(' || v || ')));' END END AS text
 FROM (SELECT *, 'v' || p_partkey AS v, CASE WHEN p_size % 4 > 0 THEN p_type END AS t FROM part), (VALUES ('warning'), ('assert'), ('report')) x(m)""")
def contract_modes(spark, d):
    """Checks of all three modes for types that are not certain or not known."""
    v = F.concat(F.lit("v"), F.col("p_partkey").cast("string"))
    t = F.when(F.col("p_size") % 4 > 0, F.col("p_type"))
    texts = F.array(*[F.struct(F.lit(m).alias("mode"), A.check_text(v, t, F.col("p_size") / 25 * 0.8, m).alias("text")) for m in ("warning", "assert", "report")])
    return Registry(spark, d).table("part").select("p_partkey", F.explode(texts).alias("x")).select("p_partkey", "x.*")
