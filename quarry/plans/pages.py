"""Fields of HTML pages and file-like sources over ``pages``, and round trips of sources and sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.sources import markup as M
from quarry.sources.registry import Registry

from .base import query


def _pages(spark, d):
    return Registry(spark, d).table("pages")


def _shared_folder(spark) -> str:
    """A fresh folder that driver and executors share; a temporary one only in a local run where none is set."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    return os.path.join(base, "quarry", uuid.uuid4().hex)


_BODY = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"


def _plain(text: str) -> str:
    out = rf"regexp_replace({text}, '(?s)<[^>]*>', ' ', 'g')"
    for ref, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{ref}', '{c}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_TITLE = _plain(rf"regexp_extract({_BODY}, '(?is)<h1[^>]*>(.*?)</h1>', 1)")


def _texts(tag: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({_BODY}, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1), lambda x: {_plain('x')}), lambda t: t <> '')"


@query("html_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def html_title(spark, d):
    return _pages(spark, d).select("page_id", M.title(F.col("html")).alias("title"))


@query("html_descr", f"SELECT page_id, array_to_string({_texts('p')}, chr(10)) AS about FROM pages")
def html_descr(spark, d):
    return _pages(spark, d).select("page_id", M.description(F.col("html")).alias("about"))


@query("html_list", f"SELECT page_id, array_to_string({_texts('li')}, '|') AS items FROM pages")
def html_list(spark, d):
    return _pages(spark, d).select("page_id", F.array_join(M.texts(F.col("html"), "li"), "|").alias("items"))


@query("html_code", f"SELECT page_id, CAST(len({_texts('pre')}) + len({_texts('b')}) AS INTEGER) AS marked FROM pages")
def html_code(spark, d):
    h = F.col("html")
    return _pages(spark, d).select("page_id", (F.size(M.texts(h, "pre")) + F.size(M.texts(h, "b"))).alias("marked"))


@query("html_links", rf"""SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all({_BODY}, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS link FROM pages)""")
def html_links(spark, d):
    return _pages(spark, d).select("page_id", F.explode(M.links(F.col("html"))).alias("link"))


@query("html_parse", f"SELECT page_id, {_TITLE} AS title, CAST(len({_texts('p')}) AS INTEGER) AS paragraphs, CAST(len({_texts('li')}) AS INTEGER) AS items FROM pages")
def html_parse(spark, d):
    # Scripts and comments are taken out once.
    pages, h = _pages(spark, d).select("page_id", M.body(F.col("html")).alias("body")), F.col("body")
    return pages.select("page_id", M.title(h, True).alias("title"), F.size(M.texts(h, "p", True)).alias("paragraphs"), F.size(M.texts(h, "li", True)).alias("items"))


@query("html_table", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS type_name, n_nationkey % 2 = 0 AS is_optional FROM nation")
def html_table(spark, d):
    """Rows of parameter tables, on pages made of nations."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    n = F.col("n_nationkey")
    html = F.concat(F.lit("<table><tr><th>Name</th><th>Type</th></tr><tr>"), cell(F.col("n_name")), cell(F.col("n_regionkey").cast("string")), cell(F.when(n % 2 == 0, "optional").otherwise("needed")), F.lit("</tr></table>"))
    return Registry(spark, d).table("nation").select("n_nationkey", F.explode(M.parameters(html)).alias("p")).select("n_nationkey", "p.name", "p.type_name", "p.is_optional")


@query("html_return", f"SELECT page_id, trim(regexp_extract({_TITLE}, '(?s)^([^.]*)', 1)) AS type, trim(regexp_extract({_TITLE}, '(?s)^[^.]*[.](.*)$', 1)) AS about FROM pages")
def html_return(spark, d):
    """``type: description``, here told by the title's first full stop."""
    kind, about = M.return_type(F.regexp_replace(F.regexp_replace(M.title(F.col("html")), ":", ";"), r"\.", ":"))
    return _pages(spark, d).select("page_id", kind.alias("type"), F.regexp_replace(F.regexp_replace(about, ":", "."), ";", ":").alias("about"))


_KIND = "CASE WHEN contains(t, '(') AND contains(t, ')') THEN 'Type' WHEN contains(t, '.') AND NOT contains(t, '...') THEN 'Method' ELSE 'Type' END"


@query("html_classify", f"SELECT page_id, {_KIND} AS kind FROM (SELECT page_id, {_TITLE} AS t FROM pages)")
def html_classify(spark, d):
    path = F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)", 1)
    return _pages(spark, d).select("page_id", M.page_kind(path, M.title(F.col("html"))).alias("kind"))


@query("availability", "SELECT r_regionkey, array_to_string(CASE WHEN r_regionkey = 0 THEN ['Server'] WHEN r_regionkey = 1 THEN ['Client', 'Mobile'] ELSE ['Server', 'Client'] END, ',') AS places FROM region")
def availability(spark, d):
    text = F.when(F.col("r_regionkey") == 0, "Сервер").when(F.col("r_regionkey") == 1, "Mobile, Client").otherwise("anywhere")
    return Registry(spark, d).table("region").select("r_regionkey", F.array_join(M.availability(text), ",").alias("places"))


@query("keyword_flags", "SELECT doc_id, contains(text, 'Только чтение') OR contains(text, 'Read only') AS readonly, contains(text, 'Для каждого') OR contains(text, 'For each') OR contains(text, 'итерация') OR contains(text, 'iteration') AS iterable, contains(text, 'индекс') OR contains(text, 'index') OR contains(text, '[]') AS indexable, contains(text, 'Сериализуемый') OR contains(text, 'Serializable') OR contains(text, 'XML') OR contains(text, 'JSON') AS serializable, contains(text, 'Обмен данными') OR contains(text, 'Data exchange') OR contains(text, 'XDTO') AS exchangeable FROM documents")
def keyword_flags(spark, d):
    return Registry(spark, d).table("documents").select("doc_id", *[c.alias(n) for n, c in M.flags(F.col("text")).items()])


@query("detect_facets", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Manager' WHEN p_size % 3 = 1 THEN 'Collection' ELSE '' END AS facets FROM part")
def detect_facets(spark, d):
    k = F.col("p_size") % 3
    name = F.when(k == 0, F.concat("p_brand", F.lit("Manager"))).when(k == 1, F.concat(F.lit("Table"), "p_brand")).otherwise(F.col("p_brand"))
    return Registry(spark, d).table("part").select("p_partkey", F.array_join(M.facets(name, F.col("p_type")), ",").alias("facets"))


@query("normalize_type", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'СправочникСсылка.' || c_mktsegment WHEN 1 THEN 'Строка' WHEN 2 THEN 'КлючЗаписиРегистраСведений.' || c_mktsegment ELSE c_mktsegment END AS type FROM customer")
def normalize_type(spark, d):
    k = F.col("c_custkey") % 4
    written = F.when(k == 0, F.concat(F.lit("cfg:CatalogRef."), "c_mktsegment")).when(k == 1, "xs:string").when(k == 2, F.concat(F.lit("cfg:InformationRegisterRecordKey."), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return Registry(spark, d).table("customer").select("c_custkey", M.type_name(written).alias("type"))


@query("composite_attr", "SELECT n_regionkey, CASE WHEN count(DISTINCT t) = 1 THEN min(t) ELSE 'Составной(' || string_agg(DISTINCT t, ', ' ORDER BY t) || ')' END AS type FROM (SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 AND n_regionkey > 1 THEN 'Число' ELSE 'Строка' END AS t FROM nation) GROUP BY n_regionkey")
def composite_attr(spark, d):
    t = F.when((F.col("n_nationkey") % 2 == 0) & (F.col("n_regionkey") > 1), M.type_name(F.lit("xs:decimal"))).otherwise(M.type_name(F.lit("xs:string")))
    g = Registry(spark, d).table("nation").select("n_regionkey", t.alias("t")).groupBy("n_regionkey").agg(F.array_sort(F.collect_set("t")).alias("t"))
    one = F.when(F.size("t") == 1, F.get("t", F.lit(0))).otherwise(F.concat(F.lit("Составной("), F.array_join("t", ", "), F.lit(")")))
    return g.select("n_regionkey", one.alias("type"))


_OBJECTS = "(SELECT c_name AS name, CASE c_custkey % 5 WHEN 0 THEN 'Catalog' WHEN 1 THEN 'Document' WHEN 2 THEN 'Register' WHEN 3 THEN 'Enum' ELSE 'Report' END AS kind FROM customer)"


def _objects(spark, d):
    k = F.col("c_custkey") % 5
    tag = F.when(k == 0, "Catalog").when(k == 1, "Document").when(k == 2, "AccumulationRegister").when(k == 3, "Enum").otherwise("Report")
    return Registry(spark, d).table("customer").select(F.col("c_name").alias("name"), M.metadata_kind(tag).alias("kind"))


@query("tag_kind", f"SELECT name, kind FROM {_OBJECTS}")
def tag_kind(spark, d):
    return _objects(spark, d)


@query("facet_expand", f"SELECT name, unnest(CASE kind WHEN 'Catalog' THEN ['Manager', 'Object', 'Reference', 'Constructor'] WHEN 'Document' THEN ['Manager', 'Object', 'Reference', 'Constructor'] WHEN 'Register' THEN ['Manager', 'Object', 'Reference'] WHEN 'Enum' THEN ['Manager', 'Reference'] ELSE ['Object'] END) AS facet FROM {_OBJECTS}")
def facet_expand(spark, d):
    return M.expand_facets(_objects(spark, d)).select("name", "facet")


@query("std_attrs", f"SELECT name AS owner, unnest(CASE kind WHEN 'Catalog' THEN ['Код', 'Наименование'] WHEN 'Document' THEN ['Номер', 'Дата', 'Проведен'] WHEN 'Register' THEN ['Период', 'Активность'] ELSE [] END) AS attribute FROM {_OBJECTS}")
def std_attrs(spark, d):
    return M.standard_attributes(_objects(spark, d)).select("owner", F.col("name").alias("attribute"))


@query("category_tree", "WITH p AS (SELECT DISTINCT list_filter(string_split(regexp_extract(url, '^[^:]+://[^/]+/([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages) SELECT DISTINCT '/' || array_to_string(p[1:k], '/') AS node, CAST(k - 1 AS INTEGER) AS depth FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM p)")
def category_tree(spark, d):
    """Nodes of the path tree with their depths, as deep as the paths are: every beginning of a path is a node, and there is no walk."""
    path = F.regexp_extract("url", r"^[^:]+://[^/]+/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    p = _pages(spark, d).select(parts.alias("p")).where(F.size("p") > 0).distinct()
    each = p.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    return each.select(F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.col("k")), "/")).alias("node"), (F.col("k") - 1).alias("depth")).distinct()


# Sources and sinks: what is written is read back


@query("json_roundtrip", "SELECT p_partkey, p_name, p_retailprice FROM part")
def json_roundtrip(spark, d):
    df = Registry(spark, d).table("part").select("p_partkey", "p_name", "p_retailprice")
    folder = _shared_folder(spark)
    df.write.json(folder)
    return spark.read.schema(df.schema).json(folder)


@query("report_csv", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def report_csv(spark, d):
    df = Registry(spark, d).table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    folder = _shared_folder(spark)
    df.write.option("header", "true").csv(folder)
    return spark.read.schema(df.schema).option("header", "true").csv(folder)


@query("ref_to_file", "SELECT n_name, min(c_custkey) AS file FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def ref_to_file(spark, d):
    """Each listed name with the first file that carries it, or none."""
    r = Registry(spark, d)
    files = r.table("customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("file"))
    return r.table("nation").join(files, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "file")
