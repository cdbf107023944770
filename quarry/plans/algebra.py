"""Weighted type unions over ``events``, and graphs over keys of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.operators import graph as G
from quarry.operators import unions as U
from quarry.sources.registry import Registry

from .base import query

#: Each event is a sighting: the user is the key, kind and quarter of the day the type, k/100 the weight.
_ROWS = "(SELECT user_id, event_type || '_' || CAST(hour(ts) // 6 AS VARCHAR) AS type, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS weight, event_id, ts FROM events)"
_NORM = f"(SELECT user_id, type, round(sum(weight), 9) AS weight FROM {_ROWS} GROUP BY user_id, type)"


def _rows(spark, d):
    e = Registry(spark, d).table("events")
    kind = F.concat("event_type", F.lit("_"), F.floor(F.hour("ts") / 6).cast("string"))
    return e.select("user_id", kind.alias("type"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("weight"), "event_id", "ts")


def _share(rows: str) -> str:
    return f"SELECT user_id, type, round(weight / sum(weight) OVER (PARTITION BY user_id), 9) AS weight FROM ({rows}) QUALIFY sum(weight) OVER (PARTITION BY user_id) > 0"


@query("wu_normalize", f"SELECT user_id, type, round(weight, 6) AS weight FROM {_NORM}")
def wu_normalize(spark, d):
    return U.normalize(_rows(spark, d), ["user_id"]).withColumn("weight", F.round("weight", 6))


#: Confidences are whole hundredths, so their mean in thousandths is told by whole numbers.
_CERTAIN = "CAST(CASE WHEN types > 1 THEN least((20 * k + n) // (2 * n), 900) ELSE (20 * k + n) // (2 * n) END AS DOUBLE) / 1000"
_KS = "SELECT user_id, event_type || '_' || CAST(hour(ts) // 6 AS VARCHAR) AS type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


@query("wu_create", f"SELECT user_id, type, round(m / n, 6) AS weight, {_CERTAIN} AS certainty FROM (SELECT user_id, type, count(*) AS m, sum(count(*)) OVER w AS n, sum(sum(k)) OVER w AS k, count(*) OVER w AS types FROM ({_KS}) GROUP BY user_id, type WINDOW w AS (PARTITION BY user_id))")
def wu_create(spark, d):
    return U.create(_rows(spark, d), ["user_id"], "weight").select("user_id", "type", F.round("weight", 6).alias("weight"), F.round("certainty", 3).alias("certainty"))


#: Each day of a user is an input: the kinds of its events by their share, errors bringing none; it is as certain as its greatest k.
_DAYS = """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'Number(10)' WHEN 'click' THEN 'Number(15,2)' ELSE event_type END AS type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
 c AS (SELECT user_id, day, type, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT user_id, day, type, n / sum(n) OVER (PARTITION BY user_id, day) AS weight FROM c),
 o AS (SELECT user_id, count(*) AS n, sum(k) AS k FROM (SELECT user_id, day, max(k) AS k FROM e GROUP BY user_id, day) GROUP BY user_id),
 w AS (SELECT user_id, type, round(sum(weight) / any_value(o.n), 9) AS weight FROM s JOIN o USING (user_id) WHERE type IS NOT NULL GROUP BY user_id, type),
 f AS (SELECT *, count(*) FILTER (type NOT LIKE 'Number(%') OVER (PARTITION BY user_id) = 0 AS one FROM w),
 h AS (SELECT user_id, type, round(weight / sum(weight) OVER (PARTITION BY user_id), 9) AS weight FROM f JOIN o USING (user_id) WHERE NOT one AND o.n > 1 AND weight >= 0.05),
 r AS (SELECT user_id, type, weight FROM f JOIN o USING (user_id) WHERE o.n = 1 UNION ALL SELECT user_id, 'Number', sum(weight) FROM f JOIN o USING (user_id) WHERE one AND o.n > 1 GROUP BY user_id
  UNION ALL SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, type) <= 5)"""


@query("wu_nested", f"{_DAYS} SELECT user_id, type, round(weight, 6) AS weight, CAST(CASE WHEN types > 1 AND n > 1 THEN least((20 * k + n) // (2 * n), 900) ELSE (20 * k + n) // (2 * n) END AS DOUBLE) / 1000 AS certainty FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS types FROM r) JOIN o USING (user_id)")
def wu_nested(spark, d):
    """Unions of unions: a user's days, each a union of what happened on it."""
    kind = F.when(F.col("event_type") == "view", "Number(10)").when(F.col("event_type") == "click", "Number(15,2)").when(F.col("event_type") != "error", F.col("event_type"))
    e = Registry(spark, d).table("events").select("user_id", F.to_date("ts").alias("day"), kind.alias("type"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    days = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("_n"), (F.max("k") / 100).alias("sure"))
    rows = e.groupBy("user_id", "day", "type").agg(F.count(F.lit(1)).alias("_m")).join(days, ["user_id", "day"]).withColumn("weight", F.col("_m") / F.col("_n"))
    return U.combine(rows, ["user_id"], "day", "sure").select("user_id", "type", F.round("weight", 6).alias("weight"), F.round("certainty", 3).alias("certainty"))


_SIMPLE = f"SELECT user_id, type, weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, type) AS rn FROM ({_share(f'SELECT * FROM {_NORM} WHERE weight >= 0.05')})) WHERE rn <= 5"


@query("wu_simplify", f"SELECT user_id, type, round(weight, 6) AS weight FROM ({_SIMPLE})")
def wu_simplify(spark, d):
    return U.simplify(_rows(spark, d), ["user_id"]).withColumn("weight", F.round("weight", 6))


@query("wu_lookup", f"SELECT user_id, count(*) FILTER (type = 'click_1') > 0 AS contains, round(sum(CASE WHEN type = 'click_1' THEN weight ELSE 0 END), 6) AS weight, (list(type ORDER BY weight DESC, type))[1] AS likely, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM {_NORM} GROUP BY user_id")
def wu_lookup(spark, d):
    return U.look_up(U.normalize(_rows(spark, d), ["user_id"]), ["user_id"], "click_1")


@query("wu_filter", f"SELECT user_id, type, round(weight, 6) AS weight FROM ({_share(f'''SELECT * FROM {_NORM} WHERE NOT starts_with(type, 'error')''')})")
def wu_filter(spark, d):
    kept = U.where(U.normalize(_rows(spark, d), ["user_id"]), ["user_id"], ~F.col("type").startswith("error"))
    return kept.withColumn("weight", F.round("weight", 6))


@query("wu_add", f"WITH a AS (SELECT user_id, type, sum(k) AS k FROM ({_KS}) GROUP BY user_id, type UNION ALL SELECT DISTINCT user_id, 'refund', 50 FROM ({_KS})), g AS (SELECT user_id, type, count(*) AS m, sum(k) AS k FROM a GROUP BY user_id, type) SELECT user_id, type, round(m / n, 6) AS weight, {_CERTAIN} AS certainty FROM (SELECT user_id, type, m, sum(m) OVER w AS n, sum(k) OVER w AS k, count(*) OVER w AS types FROM g WINDOW w AS (PARTITION BY user_id))")
def wu_add(spark, d):
    added = U.add(U.normalize(_rows(spark, d), ["user_id"]), ["user_id"], "refund", 0.5)
    return added.select("user_id", "type", F.round("weight", 6).alias("weight"), F.round("certainty", 3).alias("certainty"))


_HALVES = [f"(SELECT user_id, type, round(sum(weight), 9) AS weight FROM {_ROWS} WHERE event_id % 2 = {k} GROUP BY user_id, type)" for k in (0, 1)]


def _halves(spark, d):
    return [_rows(spark, d).where(F.col("event_id") % 2 == k) for k in (0, 1)]


@query("wu_intersect", f"SELECT a.user_id, a.type, round(a.weight * b.weight, 6) AS weight FROM {_HALVES[0]} a JOIN {_HALVES[1]} b ON a.user_id = b.user_id AND a.type = b.type")
def wu_intersect(spark, d):
    return U.intersect(*_halves(spark, d), ["user_id"]).withColumn("weight", F.round("weight", 6))


@query("wu_merge", f"SELECT user_id, type, round(sum(weight * 0.5), 6) AS weight FROM (SELECT * FROM {_HALVES[0]} UNION ALL SELECT * FROM {_HALVES[1]}) GROUP BY user_id, type")
def wu_merge(spark, d):
    return U.merge(*_halves(spark, d), ["user_id"]).withColumn("weight", F.round("weight", 6))


_MERGE = "(SELECT user_id, type, n / sum(n) OVER (PARTITION BY user_id) AS weight FROM (SELECT user_id, event_type AS type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2))"


@query("flow_merge", f"SELECT user_id, type, round(weight, 6) AS weight FROM {_MERGE}")
def flow_merge(spark, d):
    """A variable (user) assigned on two branches: the merge holds both branches' types by their share."""
    e = Registry(spark, d).table("events")
    branches = e.where("event_type = 'click'").unionByName(e.where("event_type = 'view'"))
    merged = U.create(branches.select("user_id", F.col("event_type").alias("type"), F.lit(1.0).alias("sure")), ["user_id"], "sure")
    return merged.select("user_id", "type", F.round("weight", 6).alias("weight"))


_EDGES = "(SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _edges(spark, d):
    r = Registry(spark, d)
    name = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    return r.table("customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")).union(r.table("nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))


#: The same with an edge from each region to the nation of its number, which closes cycles.
_LOOPED = f"(SELECT * FROM {_EDGES} UNION ALL SELECT 'r' || r_regionkey, 'n' || r_regionkey FROM region)"


def _looped(spark, d):
    back = Registry(spark, d).table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("n"), F.col("r_regionkey").cast("string")))
    return _edges(spark, d).union(back)


@query("deps_direct", f"SELECT 'out' AS way, dst AS node FROM (SELECT DISTINCT dst FROM {_EDGES} WHERE src = 'n3') UNION ALL SELECT 'in', src FROM (SELECT DISTINCT src FROM {_EDGES} WHERE dst = 'n3')")
def deps_direct(spark, d):
    e = _edges(spark, d)
    return G.dependencies(e, "n3").select(F.lit("out").alias("way"), "node").union(G.dependents(e, "n3").select(F.lit("in"), "node"))


_WALK = "WITH RECURSIVE w AS (SELECT src AS start, src AS node, 0 AS depth FROM {e} UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN {e} e ON e.src = w.node WHERE w.depth < 8) SELECT start, node, min(depth) AS depth FROM w GROUP BY start, node"


@query("graph_reach", _WALK.format(e=_EDGES))
def graph_reach(spark, d):
    e = _edges(spark, d)
    return G.reach(e, e.select(F.col("src").alias("start")).distinct())


@query("graph_path", "SELECT * FROM (SELECT 0 AS place, 'c7' AS node UNION ALL SELECT 1, 'n' || c_nationkey FROM customer WHERE c_custkey = 7 UNION ALL SELECT 2, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7)")
def graph_path(spark, d):
    goal = Registry(spark, d).table("customer").where("c_custkey = 7").join(Registry(spark, d).table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()[0]
    return G.shortest_path(_edges(spark, d), "c7", f"r{goal}")


@query("graph_cycles", f"WITH RECURSIVE w AS (SELECT DISTINCT src AS start, dst AS node, 1 AS depth FROM {_LOOPED} WHERE NOT starts_with(src, 'c') UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN {_LOOPED} e ON e.src = w.node WHERE w.depth < 12), r AS (SELECT DISTINCT start, node FROM w) SELECT a.start AS node, min(b.node) AS cycle FROM r a JOIN r b ON a.start = b.start JOIN r c ON c.start = b.node AND c.node = a.start WHERE a.start = a.node GROUP BY a.start")
def graph_cycles(spark, d):
    return G.cycles(_looped(spark, d))


@query("graph_topo", f"SELECT DISTINCT node, CAST(CASE WHEN starts_with(node, 'c') THEN 0 WHEN starts_with(node, 'n') THEN CASE WHEN node IN (SELECT dst FROM {_EDGES}) THEN 1 ELSE 0 END ELSE 2 END AS INTEGER) AS level FROM (SELECT src AS node FROM {_EDGES} UNION SELECT dst FROM {_EDGES})")
def graph_topo(spark, d):
    return G.levels(_edges(spark, d))


@query("call_topo", f"SELECT DISTINCT node, CAST(CASE WHEN starts_with(node, 'r') THEN 0 WHEN starts_with(node, 'n') THEN 1 ELSE 2 END AS INTEGER) AS level FROM (SELECT src AS node FROM {_EDGES} UNION SELECT dst FROM {_EDGES})")
def call_topo(spark, d):
    """Callees before callers: the levels of the reversed edges."""
    return G.levels(_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("called_functions", f"SELECT DISTINCT dst AS node FROM {_EDGES} WHERE src = 'c11'")
def called_functions(spark, d):
    return G.dependencies(_edges(spark, d), "c11")


# Rules over single rows


@query("narrow_invert", "SELECT event_id, CASE event_type WHEN 'click' THEN 'not equals' WHEN 'view' THEN 'type is not' WHEN 'error' THEN 'falsy' END AS otherwise FROM events")
def narrow_invert(spark, d):
    kind = F.when(F.col("event_type") == "click", "equals").when(F.col("event_type") == "view", "type is").when(F.col("event_type") == "error", "truthy").otherwise("other")
    return Registry(spark, d).table("events").select("event_id", A.invert(kind).alias("otherwise"))


@query("assign_compat", "SELECT a.event_id, a.event_type = b.event_type AS compatible FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def assign_compat(spark, d):
    """A value fits where its category is that of what it replaces."""
    e = Registry(spark, d).table("events").select("event_id", "event_type")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("other"))
    return e.join(after, "event_id").select("event_id", (F.col("event_type") == F.col("other")).alias("compatible"))


@query("line_diag", r"SELECT doc_id, CAST(line AS INTEGER) AS line, trim(regexp_extract(code, '^([^=]*)=', 1)) AS left_side, trim(regexp_extract(code, '=(.*)$', 1)) AS right_side FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS code, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents) WHERE contains(code, '=') AND NOT regexp_matches(code, '==|<=|>=') AND NOT starts_with(ltrim(code), '//')")
def line_diag(spark, d):
    return A.line_assignments(Registry(spark, d).table("documents"), "doc_id", "text")


@query("resolve_path", "SELECT p AS path, CASE WHEN n = 'c_name' THEN 'String' WHEN n = 'balance' THEN 'Number' END AS type, CASE WHEN n = 'c_name' THEN 0.9 WHEN n = 'balance' THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT c_mktsegment || '.' || CASE c_custkey % 3 WHEN 0 THEN 'c_name' WHEN 1 THEN 'balance' ELSE 'none' END AS p, CASE c_custkey % 3 WHEN 0 THEN 'c_name' WHEN 1 THEN 'balance' ELSE 'none' END AS n FROM customer)")
def resolve_path(spark, d):
    c = Registry(spark, d).table("customer")
    k = F.col("c_custkey") % 3
    paths = c.select(F.concat("c_mktsegment", F.lit("."), F.when(k == 0, "c_name").when(k == 1, "balance").otherwise("none")).alias("path"))
    owners = c.select(F.col("c_mktsegment").alias("owner")).distinct()
    members = owners.select("owner", F.explode(F.array(F.struct(F.lit("c_name").alias("name"), F.lit("property").alias("kind"), F.lit("String").alias("type")), F.struct(F.lit("balance").alias("name"), F.lit("method").alias("kind"), F.lit("Number").alias("type")))).alias("m")).select("owner", "m.*")
    return A.resolve_path(paths, members)


@query("resolve_manager", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'CatalogManager' WHEN c_custkey % 4 = 1 THEN 'DocumentManager' END AS kind, CAST(CASE WHEN c_custkey % 4 = 0 THEN 0.8 WHEN c_custkey % 4 = 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS confidence FROM customer")
def resolve_manager(spark, d):
    k = F.col("c_custkey") % 4
    path = F.when(k == 0, F.concat(F.lit("Справочники."), "c_mktsegment")).when(k == 1, "Документы").when(k == 2, "Catalogs.a.b").otherwise("Другое.x")
    kind, sure = A.manager(path)
    return Registry(spark, d).table("customer").select("c_custkey", kind.alias("kind"), sure.alias("confidence"))


@query("facet_infer", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'Collection' WHEN contains(p_name, 'bolt') THEN 'Object' ELSE 'Reference' END AS facet FROM part")
def facet_infer(spark, d):
    """A facet by words of the text; without any the default."""
    name = F.col("p_name")
    return Registry(spark, d).table("part").select("p_partkey", F.when(name.contains("ring"), "Collection").when(name.contains("bolt"), "Object").otherwise("Reference").alias("facet"))


@query("contracts", """SELECT event_id, CASE WHEN k < 80 THEN 'If TypeOf(' || event_type || ') <> Type("Number") Then Raise "' || event_type || ': Number expected"; EndIf;' END AS contract FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def contracts(spark, d):
    sure = F.get_json_object("props", "$.k").cast("double") / 100
    return Registry(spark, d).table("events").select("event_id", A.contract(F.col("event_type"), F.lit("Number"), sure).alias("contract"))


@query("type_hint", "SELECT user_id, CASE WHEN len(t) <= 3 THEN array_to_string(t, '|') ELSE 'Union<' || len(t) || '>' END || CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN '~' ELSE '?' END AS hint FROM (SELECT user_id, list_sort(list_distinct(list(event_type))) AS t FROM events GROUP BY user_id)")
def type_hint(spark, d):
    g = Registry(spark, d).table("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    sure = F.when(F.col("user_id") % 3 == 1, 0.95).when(F.col("user_id") % 3 == 2, 0.5)
    return g.select("user_id", A.type_hint(F.col("t"), sure).alias("hint"))


@query("type_hint_whole", "SELECT user_id, CASE WHEN len(t) <= 3 THEN array_to_string(t, '|') ELSE 'Union<' || len(t) || '>' END || CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN '~' ELSE '?' END AS hint FROM (SELECT user_id, list_sort(list_distinct(list(event_type))) AS t FROM events GROUP BY user_id)")
def type_hint_whole(spark, d):
    """Hints of all users from all their events."""
    g = Registry(spark, d).table("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    sure = F.when(F.col("user_id") % 3 == 1, 0.95).when(F.col("user_id") % 3 == 2, 0.5)
    return g.select("user_id", A.type_hint(F.col("t"), sure).alias("hint"))
