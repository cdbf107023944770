"""Configuration files written from the tables and read back as sources; register kinds, temporary tables, caches, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.operators import repository as R
from quarry.sources import markup as M
from quarry.sources.registry import Registry

from .base import query
from .pages import _TITLE, _pages, _shared_folder

_TAGS = ("Catalog", "Document", "InformationRegister", "Enum", "Report", "Task")
_TAG = "['Catalog', 'Document', 'InformationRegister', 'Enum', 'Report', 'Task'][s_suppkey % 6 + 1]"
_KIND = "['Catalog', 'Document', 'Register', 'Enum', 'Report', 'DataProcessor'][s_suppkey % 6 + 1]"
_FACETS = "CASE s_suppkey % 6 WHEN 0 THEN ['Manager', 'Object', 'Reference', 'Constructor'] WHEN 1 THEN ['Manager', 'Object', 'Reference', 'Constructor'] WHEN 2 THEN ['Manager', 'Object', 'Reference'] WHEN 3 THEN ['Manager', 'Reference'] ELSE ['Object'] END"


def _configuration(spark, d):
    """Files of all suppliers as objects, and the root index, which lists them and a language; a seventh of the objects has no file."""
    k = F.col("s_suppkey")
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (k % 6 + 1).cast("int"))
    name = F.concat(F.lit("S"), k.cast("string"))
    types = F.array(*[F.lit(t) for t in ("xs:string", "xs:decimal", "cfg:CatalogRef.Goods", "cfg:EnumRef.Units")])
    typed = lambda n, at: F.transform(F.slice(types, F.lit(1), n), lambda t: F.concat(F.lit("<v8:Type>"), t, F.lit("</v8:Type>")))
    field = lambda what, label, n: F.concat(F.lit(f"<{what}><Properties><Name>{label}</Name>"), F.when(n > 0, F.concat(F.lit("<Type>"), F.array_join(typed(n, 0), ""), F.lit("</Type>"))).otherwise(""), F.lit(f"</Properties></{what}>"))
    count = (k % 5).cast("int")
    fields = F.concat(field("Attribute", "First", count), F.when(k % 6 == 2, field("Dimension", "Key", F.lit(1))).otherwise(""))
    table = F.when(k % 6 == 1, F.concat(F.lit("<TabularSection><Properties><Name>Rows</Name></Properties><ChildObjects>"), field("Attribute", "Cell", F.lit(2)), field("Attribute", "Note", count), F.lit("</ChildObjects></TabularSection>"))).otherwise("")
    text = F.concat(F.lit('<?xml version="1.0"?>\n<MetaDataObject xmlns="m">\n<'), tag, F.lit(' uuid="'), k.cast("string"), F.lit('"><Properties><Name>'), name, F.lit("</Name></Properties>\n<ChildObjects>"), fields, table, F.lit("</ChildObjects></"), tag, F.lit("></MetaDataObject>"))
    suppliers = Registry(spark, d).table("supplier")
    objects = suppliers.where(k % 7 != 6).select(F.concat(tag, F.lit("s/"), name, F.lit(".xml")).alias("path"), text.alias("content"))
    # The index is one file, so its list is one row by nature.
    listed = suppliers.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<"), tag, F.lit(">"), name, F.lit("</"), tag, F.lit(">")))), "").alias("l"))
    index = listed.select(F.lit("Configuration.xml").alias("path"), F.concat(F.lit("<MetaDataObject><Configuration><Properties><Name>Demo</Name></Properties><ChildObjects><Language>en</Language>"), "l", F.lit("</ChildObjects></Configuration></MetaDataObject>")).alias("content"))
    folder = _shared_folder(spark)
    M.write_files(objects.unionByName(index), folder)
    return M.xml_files(spark, folder)


@query("src_config_guided", f"SELECT {_TAG} AS tag, 'S' || s_suppkey AS name, {_KIND} AS kind, s_suppkey % 7 <> 6 AS found, unnest({_FACETS}) AS facet FROM supplier")
def src_config_guided(spark, d):
    """What the root index lists, whether its file is there, and a row for each facet."""
    files = _configuration(spark, d)
    own = files.select(F.regexp_extract("content", r"(?s)<MetaDataObject\b[^>]*>\s*<([A-Za-z]+)", 1).alias("tag"), F.regexp_extract("content", r"(?s)<Properties>\s*<Name>([^<]+)", 1).alias("name"), F.lit(True).alias("found"))
    listed = M.references(files).join(own, ["tag", "name"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return M.expand_facets(listed).select("tag", "name", "kind", "found", "facet")


_WRITTEN = "['Строка', 'Число', 'СправочникСсылка.Goods', 'ПеречислениеСсылка.Units']"


def _type(n: str) -> str:
    return f"CASE {n} WHEN 0 THEN 'Произвольный' WHEN 1 THEN 'Строка' ELSE 'Составной(' || array_to_string({_WRITTEN}[1:{n}], ', ') || ')' END"


_OWN = f"SELECT 'S' || s_suppkey AS owner, {_KIND} AS kind, s_suppkey FROM supplier WHERE s_suppkey % 7 <> 6"


@query("src_config_xml", f"SELECT owner, kind, 'First' AS name, {_type('s_suppkey % 5')} AS type, s_suppkey % 5 > 1 AS is_composite FROM ({_OWN}) UNION ALL SELECT owner, kind, 'Key', 'Строка', FALSE FROM ({_OWN}) WHERE s_suppkey % 6 = 2")
def src_config_xml(spark, d):
    """Attributes, dimensions and resources of all object files below a folder."""
    return M.attributes(_configuration(spark, d)).where("section = ''").select("owner", "kind", "name", "type", "is_composite")


@query("tabular_section", f"SELECT owner, 'Rows' AS section, 'Cell' AS name, {_type('2')} AS type FROM ({_OWN}) WHERE s_suppkey % 6 = 1 UNION ALL SELECT owner, 'Rows', 'Note', {_type('s_suppkey % 5')} FROM ({_OWN}) WHERE s_suppkey % 6 = 1")
def tabular_section(spark, d):
    """Attributes nested in tables of objects."""
    return M.attributes(_configuration(spark, d)).where("section <> ''").select("owner", "section", "name", "type")


@query("src_xml_discovery", f"SELECT {_TAG} || 's/S' || s_suppkey || '.xml' AS file, {_TAG} AS tag, {_KIND} AS kind FROM supplier WHERE s_suppkey % 7 <> 6 UNION ALL SELECT 'Configuration.xml', 'Configuration', NULL")
def src_xml_discovery(spark, d):
    """Every file below a folder by its first element within the metadata root."""
    return M.root_kind(_configuration(spark, d)).select(F.regexp_extract("path", r"((?:[^/]+s/)?[^/]+)$", 1).alias("file"), "tag", "kind")


# Register kinds beside the information register


@query("scan_register_accumulation", "SELECT l_shipdate AS period, l_orderkey AS recorder, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def scan_register_accumulation(spark, d):
    return Registry(spark, d).scan("lineitem")


@query("scan_register_accounting", "SELECT o_orderdate AS period, o_orderkey AS recorder, o_custkey AS debit, o_orderpriority AS credit, o_totalprice AS amount FROM orders")
def scan_register_accounting(spark, d):
    """Entries with both their accounts."""
    return Registry(spark, d).entries("orders")


@query("scan_register_calculation", "SELECT date_trunc('month', l_shipdate) AS registration_period, l_shipdate AS period, l_orderkey AS recorder, l_suppkey, l_quantity AS result FROM lineitem")
def scan_register_calculation(spark, d):
    """Records by the month that they are registered in."""
    return Registry(spark, d).calculations("lineitem")


@query("temp_table_named", "WITH big AS (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 3), seg AS (SELECT c_mktsegment, o_custkey, orders FROM big JOIN customer ON c_custkey = o_custkey) SELECT c_mktsegment, count(*) AS customers, CAST(sum(orders) AS BIGINT) AS orders FROM seg GROUP BY c_mktsegment")
def temp_table_named(spark, d):
    """A batch of three queries: each puts a named table that the next one reads by its name, and both are dropped after it."""
    r = Registry(spark, d)
    names = ("quarry_big", "quarry_segments")
    r.table("orders").createOrReplaceTempView("quarry_orders")
    r.table("customer").createOrReplaceTempView("quarry_customers")
    spark.sql("SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS total FROM quarry_orders GROUP BY o_custkey HAVING count(*) >= 3").createOrReplaceTempView(names[0])
    spark.sql(f"SELECT c_mktsegment, o_custkey, orders FROM {names[0]} JOIN quarry_customers ON c_custkey = o_custkey").createOrReplaceTempView(names[1])
    out = spark.sql(f"SELECT c_mktsegment, count(*) AS customers, sum(orders) AS orders FROM {names[1]} GROUP BY c_mktsegment")
    for name in (*names, "quarry_orders", "quarry_customers"):
        spark.catalog.dropTempView(name)
    return out


# Pages


@query("html_examples", f"SELECT n_nationkey, n_name || ' = ' || n_regionkey || ';' || chr(10) || '    a < b && \"c\";' AS example FROM nation UNION ALL SELECT n_nationkey, 'call(' || n_name || ')' FROM nation WHERE n_nationkey % 2 = 0")
def html_examples(spark, d):
    """Code examples as they are written, with line breaks and decoded references, on pages made of nations."""
    n = F.col("n_nationkey")
    html = F.concat(F.lit("<h1>T</h1><script><pre>no</pre></script><pre class='x'>"), "n_name", F.lit(" = <b>"), F.col("n_regionkey").cast("string"), F.lit("</b>;\n    a &lt; b &amp;&amp; &quot;c&quot;;</pre><pre> </pre>"), F.when(n % 2 == 0, F.concat(F.lit("<p>so <code>call("), "n_name", F.lit(")</code></p>"))).otherwise(""))
    return Registry(spark, d).table("nation").select("n_nationkey", F.explode(M.examples(html)).alias("example"))


@query("return_types", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand || '.' || p_type END AS type, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE p_name || ': more' END AS about FROM part")
def return_types(spark, d):
    """``type: description`` cut at the first colon; without one all is the type."""
    k = F.col("p_size") % 3
    text = F.when(k == 0, F.concat(F.lit("  "), "p_type")).otherwise(F.concat("p_brand", F.lit("."), "p_type", F.lit(" :  "), "p_name", F.when(k == 2, ": more").otherwise("")))
    kind, about = M.return_type(text)
    return Registry(spark, d).table("part").select("p_partkey", kind.alias("type"), about.alias("about"))


@query("page_kinds", "SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'GlobalFunction' WHEN 1 THEN 'Category' WHEN 2 THEN 'Method' WHEN 3 THEN 'Property' WHEN 4 THEN 'Constructor' WHEN 5 THEN 'Type' WHEN 6 THEN 'Method' ELSE 'Type' END AS kind FROM part")
def page_kinds(spark, d):
    """All kinds of help pages by path and title."""
    k = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    paths = [F.concat(F.lit("/objects/Global context/methods/"), k, F.lit(".html")), F.concat(F.lit("/objects/catalog"), F.col("p_partkey").cast("string"), F.lit(".html")), *[F.concat(F.lit(f"/objects/T/{f}/"), k, F.lit(".html")) for f in ("methods", "properties", "constructors")], *[F.concat(F.lit("/objects/T/"), k, F.lit(".html"))] * 3]
    titles = [F.concat(F.lit("Global context."), k), *[k] * 4, F.concat(k, F.lit(" (T)")), F.concat(F.lit("T."), k), F.concat(k, F.lit("..."))]
    at = (F.col("p_size") % 8 + 1).cast("int")
    return Registry(spark, d).table("part").select("p_partkey", M.page_kind(F.element_at(F.array(*paths), at), F.element_at(F.array(*titles), at)).alias("kind"))


@query("category_nodes", f"""WITH p AS (SELECT list_filter(string_split(regexp_extract(url, '^[^:]+://[^/]+/([^?#]*)', 1), '/'), lambda x: x <> '') AS p, {_TITLE} AS t FROM pages),
 w AS (SELECT p, t, unnest(range(1, len(p) + 1)) AS d FROM p)
 SELECT '/' || array_to_string(p[1:d], '/') AS node, CASE WHEN d > 1 THEN '/' || array_to_string(p[1:d - 1], '/') END AS parent, CAST(d AS INTEGER) AS depth, min(CASE WHEN d = len(p) THEN t END) AS title, count(*) AS pages FROM w GROUP BY ALL""")
def category_nodes(spark, d):
    """The tree of URL paths at any depth, with titles of the pages that are nodes themselves."""
    told = _pages(spark, d).select(F.regexp_extract("url", r"^[^:]+://[^/]+/([^?#]*)", 1).alias("path"), M.title(F.col("html")).alias("title"), F.lit("").alias("about"))
    return M.categories(told).drop("about")


# Cache and reports


_KEY = "left(sha256(text), 16) || ':v2'"


@query("cache_lifecycle", f"WITH e AS (SELECT {_KEY} AS key, min(doc_id) AS doc_id, CAST(max(n_chars) AS BIGINT) AS result FROM documents WHERE doc_id % 3 > 0 GROUP BY 1) SELECT key, doc_id, result FROM e WHERE NOT starts_with(key, '0') AND result > 300")
def cache_lifecycle(spark, d):
    """Results put under keys of content and version, some put again, some invalidated by key, the small ones cleaned, the rest read."""
    docs = Registry(spark, d).table("documents").withColumn("key", R.cache_key(F.col("text"), "v2"))
    fresh = lambda rows: rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_chars").alias("result"))
    cache = R.cache_put(fresh(docs.where("doc_id % 3 = 1")), fresh(docs.where("doc_id % 3 > 0")), ["key"])
    cache = R.cache_drop(cache, docs.where(F.col("key").startswith("0")).select("key"))
    return cache.where("result > 300").select("key", "doc_id", "result")


@query("report_json", "SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag")
def report_json(spark, d):
    df = Registry(spark, d).table("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    folder = _shared_folder(spark)
    df.write.json(folder)
    return spark.read.schema(df.schema).json(folder)


@query("report_text", "SELECT event_type || ': ' || count(*) || ' events of ' || count(DISTINCT user_id) || ' users' AS line FROM events GROUP BY event_type")
def report_text(spark, d):
    g = Registry(spark, d).table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("u"))
    folder = _shared_folder(spark)
    g.select(F.format_string("%s: %d events of %d users", "event_type", "n", "u").alias("value")).write.text(folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query("path_types", "SELECT p_partkey, p AS path, CASE WHEN n = 1 THEN 'Part' WHEN n = 2 THEN 'Supplier' WHEN n = 3 THEN 'String' WHEN n = 4 THEN 'Number' END AS type, round(CASE n WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 0.9 WHEN 4 THEN 0.7 ELSE 0 END, 6)::DOUBLE AS confidence FROM (SELECT p_partkey, p_size % 5 + 1 AS n, ['Part', 'Part.maker', 'Part.maker.name', 'Part.maker.rating', 'Part.maker.none.more'][p_size % 5 + 1] AS p FROM part)")
def path_types(spark, d):
    """Dotted expressions of any length, a member a step."""
    texts = F.array(*map(F.lit, ("Part", "Part.maker", "Part.maker.name", "Part.maker.rating", "Part.maker.none.more")))
    paths = Registry(spark, d).table("part").select("p_partkey", F.element_at(texts, (F.col("p_size") % 5 + 1).cast("int")).alias("path"))
    members = spark.createDataFrame([("Part", "maker", "property", "Supplier"), ("Supplier", "name", "property", "String"), ("Supplier", "rating", "method", "Number")], "owner string, name string, kind string, type string")
    found = A.resolve_paths(paths.select("path").distinct(), members)
    return paths.join(found, "path").select("p_partkey", "path", "type", F.round("confidence", 6).alias("confidence"))


@query("line_diagnostics", "SELECT p_partkey, 1 AS line, 'warning' AS severity, 'x is a Number and gets a String' AS message FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 2, 'warning', 'y is a String and gets a Boolean' FROM part WHERE p_size % 4 = 2")
def line_diagnostics(spark, d):
    """Assignments, line by line, of values whose type isn't that of the variable."""
    k = F.col("p_size") % 4
    text = F.concat(F.lit("// x = 1\n"), F.when(k == 0, 'x = "text";').otherwise("x = 5;"), F.lit("\n"), F.when(k == 2, "y = True;").when(k == 3, "y == 4;").otherwise('y = "a";'), F.lit("\nz <= 3;\nif q >= 1"))
    typed = spark.createDataFrame([("x", "Number"), ("y", "String"), ("z", "Number")], "variable string, type string")
    return A.assignment_diagnostics(Registry(spark, d).table("part").select("p_partkey", text.alias("text")), "p_partkey", "text", typed)


_OUTPUTS = ("p.p_name", "upper(p_brand)", "p_size + {}", "p_retailprice * 2", "p_type КАК kind", "count(*)", "p_name", "{} AS p_name")


@query("output_names", f"""WITH o AS (SELECT p_partkey, x.place, replace(x.text, '{{}}', CAST(p_size AS VARCHAR)) AS text, x.base FROM part, (VALUES {', '.join(f"({k}, '{t}', '{n}')" for k, (t, n) in enumerate(zip(_OUTPUTS, ('p_name', 'upper', 'Expression', 'Expression', 'kind', 'count', 'p_name', 'p_name'), strict=True)))}) x(place, text, base) WHERE (p_partkey + x.place) % 3 > 0)
 SELECT p_partkey, place, text, base || CASE WHEN k > 1 THEN CAST(k - 1 AS VARCHAR) ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, base ORDER BY place) AS k FROM o)""")
def output_names(spark, d):
    """A query of some written outputs for each part: aliases, fields, functions, other expressions, and repeats."""
    texts = F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("p_size").cast("string")) for t in _OUTPUTS])
    each = Registry(spark, d).table("part").select("p_partkey", F.posexplode(texts).alias("place", "text"), "p_size").where((F.col("p_partkey") + F.col("place")) % 3 > 0)
    return R.output_names(each, ["p_partkey"]).select("p_partkey", "place", "text", "name")
