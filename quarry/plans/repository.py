"""The metadata store over type rows made of ``part``: filters, look-ups, roll-ups, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import repository as R
from quarry.operators import search as S
from quarry.sources.registry import Registry

from .base import query

#: Parts as type rows: the first word of the name leads, the type is the category.
TYPES = """(SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, upper(p_name) AS alt_name,
 CASE p_size % 3 WHEN 0 THEN 'Platform' WHEN 1 THEN 'Configuration' ELSE 'UserDefined' END AS source,
 CASE WHEN p_size % 7 = 0 THEN [] ELSE [p_type, p_brand] END AS category_path,
 CASE WHEN p_size % 4 = 0 THEN [] ELSE ['get_' || p_size, 'set_' || p_size] END AS methods,
 CASE WHEN p_size % 5 = 0 THEN [] ELSE ['size'] END AS properties,
 list_filter([CASE WHEN p_size % 2 = 0 THEN 'Manager' END, CASE WHEN p_size > 25 THEN 'Object' END, 'Reference'], lambda x: x IS NOT NULL) AS facets FROM part)"""


def types(spark, d):
    p = Registry(spark, d).table("part")
    size = F.col("p_size")
    none = F.array().cast("array<string>")
    text = size.cast("string")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.upper("p_name").alias("alt_name"),
        F.when(size % 3 == 0, "Platform").when(size % 3 == 1, "Configuration").otherwise("UserDefined").alias("source"),
        F.when(size % 7 == 0, none).otherwise(F.array("p_type", "p_brand")).alias("category_path"),
        F.when(size % 4 == 0, none).otherwise(F.array(F.concat(F.lit("get_"), text), F.concat(F.lit("set_"), text))).alias("methods"),
        F.when(size % 5 == 0, none).otherwise(F.array(F.lit("size"))).alias("properties"),
        F.array_compact(F.array(F.when(size % 2 == 0, "Manager"), F.when(size > 25, "Object"), F.lit("Reference"))).alias("facets"),
    )


@query("repo_filter", f"SELECT id, name FROM {TYPES} WHERE source = 'Platform' AND len(list_filter(category_path, lambda c: contains(lower(c), 'econ'))) > 0 AND (contains(lower(name), 'ring') OR contains(lower(alt_name), 'ring')) AND list_contains(facets, 'Reference') AND len(methods) > 0")
def repo_filter(spark, d):
    wanted = R.Filter(source="Platform", category="ECON", name_contains="RING", facet="Reference", has_methods=True)
    return types(spark, d).where(wanted.predicate()).select("id", "name")


@query("repo_search", f"SELECT id, name FROM {TYPES} WHERE contains(lower(name), 'bolt')")
def repo_search(spark, d):
    return R.find(types(spark, d), "Bolt").select("id", "name")


@query("facet_all", f"SELECT id FROM {TYPES} WHERE list_contains(facets, 'Manager') AND list_contains(facets, 'Object')")
def facet_all(spark, d):
    return R.with_all_facets(types(spark, d), ["Manager", "Object"]).select("id")


@query("facet_any", f"SELECT id FROM {TYPES} WHERE list_contains(facets, 'Manager') OR list_contains(facets, 'Object')")
def facet_any(spark, d):
    return R.with_any_facet(types(spark, d), ["Manager", "Object"]).select("id")


@query("by_category", f"SELECT id FROM {TYPES} WHERE list_contains(category_path, 'PROMO')")
def by_category(spark, d):
    return R.in_category(types(spark, d), "PROMO").select("id")


_LOOK = f"SELECT id, name, CASE WHEN id = 'red widget' OR name = 'red widget' THEN 1 ELSE 2 END AS priority FROM {TYPES} WHERE id = 'red widget' OR name = 'red widget'"


@query("fuzzy_lookup", _LOOK)
def fuzzy_lookup(spark, d):
    return R.look_up(types(spark, d), "red widget").select("id", "name", "priority")


@query("bilingual_lookup", f"WITH t AS {TYPES}, w AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN 'red widget' ELSE 'BLUE BOLT' END AS wanted FROM nation UNION ALL SELECT r_name FROM region WHERE r_regionkey = 0) SELECT wanted, coalesce((SELECT min(id) FROM t WHERE name = wanted), (SELECT min(id) FROM t WHERE alt_name = wanted)) AS id FROM w")
def bilingual_lookup(spark, d):
    r = Registry(spark, d)
    wanted = r.table("nation").select(F.when(F.col("n_nationkey") % 2 == 0, "red widget").otherwise("BLUE BOLT").alias("wanted")).distinct().union(r.table("region").where("r_regionkey = 0").select("r_name"))
    return R.bilingual(wanted, types(spark, d))


@query("by_facet", f"SELECT id FROM {TYPES} WHERE list_contains(facets, 'Manager')")
def by_facet(spark, d):
    return types(spark, d).where(R.Filter(facet="Manager").predicate()).select("id")


@query("completions", f"SELECT DISTINCT m AS label, k AS kind FROM (SELECT unnest(methods) AS m, 'method' AS k, name FROM {TYPES} UNION ALL SELECT unnest(properties), 'property', name FROM {TYPES}) WHERE name = 'red widget' AND starts_with(m, 'se')")
def completions(spark, d):
    return R.completions(types(spark, d), "red widget.se")


@query("global_completions", f"SELECT DISTINCT name AS label, 'type' AS kind FROM {TYPES} WHERE starts_with(name, 're')")
def global_completions(spark, d):
    return R.completions(types(spark, d), "re")


@query("scope_completions", f"SELECT label, kind, signature FROM (SELECT DISTINCT unnest(methods) AS label, 'function' AS kind, unnest(methods) || '()' AS signature FROM {TYPES} UNION ALL SELECT DISTINCT unnest(properties), 'variable', unnest(properties) FROM {TYPES}) WHERE starts_with(label, 's')")
def scope_completions(spark, d):
    """Functions and variables in scope that begin with the text, case told apart, with signatures."""
    t = types(spark, d)
    functions = t.select(F.explode("methods").alias("label")).distinct().select("label", F.lit("function").alias("kind"), F.concat("label", F.lit("()")).alias("signature"))
    variables = t.select(F.explode("properties").alias("label")).distinct().select("label", F.lit("variable").alias("kind"), F.col("label").alias("signature"))
    return functions.union(variables).where(F.col("label").startswith("s"))


@query("display_projection", f"SELECT id, name, CASE source WHEN 'Platform' THEN 'Platform' WHEN 'Configuration' THEN category_path[1] ELSE 'Unknown' END AS category, name || ': ' || len(methods) || ' methods, ' || len(properties) || ' properties' AS description FROM {TYPES}")
def display_projection(spark, d):
    return R.display(types(spark, d))


@query("detail_projection", f"SELECT id, array_to_string(methods, ',') AS methods, array_to_string(properties, ',') AS properties, array_to_string(facets, ',') AS facets FROM {TYPES}")
def detail_projection(spark, d):
    return types(spark, d).select("id", *[F.array_join(c, ",").alias(c) for c in ("methods", "properties", "facets")])


@query("to_repo_rows", "SELECT 'Catalog.' || c_name AS id, c_name AS name, 'Catalog' AS category, 'code,description' AS properties FROM customer")
def to_repo_rows(spark, d):
    """Objects as store rows: kind and name make the id, standard fields the properties."""
    c = Registry(spark, d).scan("customer")
    return c.select(F.concat(F.lit("Catalog."), "description").alias("id"), F.col("description").alias("name"), F.lit("Catalog").alias("category"), F.lit("code,description").alias("properties"))


@query("repo_stats", f"SELECT count(*) AS total, count(*) FILTER (source = 'Platform') AS platform, count(*) FILTER (source = 'Configuration') AS configuration, count(*) FILTER (source = 'UserDefined') AS user_defined FROM {TYPES}")
def repo_stats(spark, d):
    return R.stats(types(spark, d))


@query("parse_stats", f"SELECT source AS kind, count(*) AS n, CAST(sum(len(methods)) AS BIGINT) AS methods FROM {TYPES} GROUP BY source")
def parse_stats(spark, d):
    return types(spark, d).groupBy(F.col("source").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("methods")).alias("methods"))


@query("discovery_stats", "SELECT p_type AS kind, count(*) AS listed, count(l_partkey) AS found, count(*) - count(l_partkey) AS missing FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON p_partkey = l_partkey GROUP BY p_type")
def discovery_stats(spark, d):
    """What is listed against what is found, by kind."""
    r = Registry(spark, d)
    found = r.table("lineitem").select("l_partkey").distinct()
    joined = r.table("part").join(found, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.groupBy(F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("listed"), F.count("l_partkey").alias("found"), (F.count(F.lit(1)) - F.count("l_partkey")).alias("missing"))


@query("category_rollup", f"SELECT coalesce(category_path[1], 'Без категории') AS category, count(*) AS types, CAST(sum(len(methods)) AS BIGINT) AS methods, CAST(sum(len(properties)) AS BIGINT) AS properties, min(name) AS example FROM {TYPES} GROUP BY 1")
def category_rollup(spark, d):
    return R.category_rollup(types(spark, d))


@query("hierarchy_explode", f"SELECT category, count(*) AS types FROM (SELECT unnest(category_path) AS category FROM {TYPES}) GROUP BY category")
def hierarchy_explode(spark, d):
    return R.hierarchy(types(spark, d))


@query("facet_counts", f"SELECT facet, count(*) AS n FROM (SELECT unnest(facets) AS facet FROM {TYPES}) GROUP BY facet")
def facet_counts(spark, d):
    return S.facet_counts(types(spark, d), "facets")


@query("facet_report", f"WITH e AS (SELECT DISTINCT unnest(facets) AS facet, name FROM {TYPES}), c AS (SELECT facet, count(*) AS n FROM (SELECT unnest(facets) AS facet FROM {TYPES}) GROUP BY facet) SELECT c.facet, c.n, x.examples FROM c JOIN (SELECT facet, string_agg(name, ', ' ORDER BY name) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY name) AS rn FROM e) WHERE rn <= 3 GROUP BY facet) x ON x.facet = c.facet")
def facet_report(spark, d):
    return R.facet_report(types(spark, d))


@query("type_index", f"SELECT facet, category, count(*) AS n, min(name) AS first_name FROM (SELECT unnest(facets) AS facet, category_path[1] AS category, name FROM {TYPES}) GROUP BY facet, category")
def type_index(spark, d):
    t = types(spark, d).select(F.explode("facets").alias("facet"), F.get("category_path", F.lit(0)).alias("category"), "name")
    return t.groupBy("facet", "category").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


@query("resolver_stats", f"SELECT measure, n FROM (UNPIVOT (SELECT count(*) AS nodes, count(*) FILTER (len(methods) > 0) AS with_methods, count(*) FILTER (len(properties) > 0) AS with_properties, count(DISTINCT name) AS names, count(DISTINCT alt_name) AS alt_names FROM {TYPES}) ON nodes, with_methods, with_properties, names, alt_names INTO NAME measure VALUE n)")
def resolver_stats(spark, d):
    one = types(spark, d).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.size("methods") > 0).alias("with_methods"), F.count_if(F.size("properties") > 0).alias("with_properties"), F.countDistinct("name").alias("names"), F.countDistinct("alt_name").alias("alt_names"))
    return one.unpivot([], one.columns, "measure", "n")


@query("kind_counts", f"SELECT source AS kind, count(*) AS objects, CAST(sum(len(properties)) AS BIGINT) AS attributes, count(*) FILTER (len(category_path) = 0) AS without_category FROM {TYPES} GROUP BY source")
def kind_counts(spark, d):
    t = types(spark, d)
    return t.groupBy(F.col("source").alias("kind")).agg(F.count(F.lit(1)).alias("objects"), F.sum(F.size("properties")).alias("attributes"), F.count_if(F.size("category_path") == 0).alias("without_category"))


@query("function_counts", f"SELECT count(*) AS total, count(DISTINCT m[1:3]) AS categories, count(*) FILTER (uses > 40) AS polymorphic, count(*) FILTER (starts_with(m, 'get_')) AS pure FROM (SELECT m, count(*) AS uses FROM (SELECT unnest(methods) AS m FROM {TYPES}) GROUP BY m)")
def function_counts(spark, d):
    """Functions by name: all, kinds by their first letters, those of many types, those that only read."""
    uses = types(spark, d).select(F.explode("methods").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("uses"))
    return uses.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(F.left("m", F.lit(3))).alias("categories"), F.count_if(F.col("uses") > 40).alias("polymorphic"), F.count_if(F.col("m").startswith("get_")).alias("pure"))


_PATHS = "(SELECT page_id, regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)"


@query("catalog_counts", f"WITH p AS (SELECT regexp_extract(path, '^/([^/]*)', 1) AS root, path FROM {_PATHS}), s AS (SELECT root, count(*) AS pages, count(DISTINCT path) AS entries FROM p GROUP BY root) SELECT root, pages, entries FROM s WHERE root <> ''")
def catalog_counts(spark, d):
    """Roots of a path tree with the pages and distinct entries below them."""
    path = F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)", 1)
    p = Registry(spark, d).table("pages").select(path.alias("path"), F.regexp_extract(path, r"^/([^/]*)", 1).alias("root"))
    return p.where("root <> ''").groupBy("root").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("path").alias("entries"))


@query("prefix_join", "SELECT n_nationkey, r_name FROM (SELECT *, '/objects/' || n_regionkey || '/' || n_name AS path FROM nation) LEFT JOIN (SELECT *, '/objects/' || r_regionkey || '/' AS prefix FROM region) ON starts_with(path, prefix)")
def prefix_join(spark, d):
    """Members linked to the folder whose path begins theirs, by equality on that folder rather than by all pairs."""
    r = Registry(spark, d)
    members = r.table("nation").select("n_nationkey", F.concat(F.lit("/objects/"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name").alias("path"))
    folders = r.table("region").select("r_name", F.concat(F.lit("/objects/"), F.col("r_regionkey").cast("string"), F.lit("/")).alias("prefix"))
    return members.withColumn("prefix", F.regexp_extract("path", r"^(/objects/[^/]+/)", 1)).join(folders, "prefix", "left").select("n_nationkey", "r_name")


@query("upsert_last", "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_last(spark, d):
    e = Registry(spark, d).table("events").select("user_id", "event_type", "value", "ts", "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return R.upsert(old, new, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value", "event_id")
