"""What is kept between runs and structures that spare whole scans: index, cache, period totals, fuzzy look-up, path links, cycles, XML."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import fuzzy_index as Z
from quarry.operators import graph as G
from quarry.operators import repository as R
from quarry.operators import search as S
from quarry.operators.completion import Completions
from quarry.operators.kept_cache import Cache
from quarry.operators.kept_index import Index
from quarry.operators.period_totals import Totals
from quarry.operators.positions import Ordered
from quarry.sources import markup as M
from quarry.sources import metadata as X
from quarry.sources.registry import Registry

from .base import query
from .pages import _shared_folder
from .text import _DOCS, _WEIGHTS, _exact, _terms


@query("search_kept", f"SELECT doc_id, score FROM ({_exact(_DOCS, ['erth', 'the', 'the', 'src3'])}) ORDER BY score DESC, doc_id LIMIT 20")
def search_kept(spark, d):
    """The first twenty by an index of three segments, two of them merged, of which only blocks that may matter are read."""
    docs = Registry(spark, d).table("documents")
    index = Index(spark, _shared_folder(spark))
    for part in (docs.where("lang = 'en'"), docs.where("lang = 'de'"), docs.where("lang IS NULL OR lang NOT IN ('en', 'de')")):
        # Dealt by document before its words are rows, so these need no shuffle.
        index.add(S.postings(part.repartition("doc_id"), "doc_id", _WEIGHTS))
    index.merge(max(s["postings"] for s in index.segments()))
    return index.search(["erth", "the", "The", "src3"], 20)


def _totals(spark, d):
    """Monthly totals of the register: open lines come late, over all months."""
    lines = Registry(spark, d).table("lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    kept = Totals(spark, _shared_folder(spark), "l_suppkey BIGINT, l_shipdate TIMESTAMP_NTZ", "l_shipdate", ["l_suppkey"], "l_quantity")
    kept.post(lines.where("l_linestatus = 'F'"), F.col("l_returnflag") == "R")
    kept.post(lines.where("l_linestatus <> 'F'"), F.col("l_returnflag") == "R")
    return kept


_SIGNED = "CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END"


@query("vt_balance_kept", f"SELECT l_suppkey, round(sum({_SIGNED}), 2) AS l_quantity_balance FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-17 12:00:00' GROUP BY l_suppkey")
def vt_balance_kept(spark, d):
    return _totals(spark, d).balance(datetime(1998, 6, 17, 12))


@query("vt_turnover_kept", "SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0), 2) AS l_quantity_receipt, round(coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 0), 2) AS l_quantity_expense FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-02-11 00:00:00' AND TIMESTAMP '1999-12-03 23:59:59' GROUP BY l_suppkey")
def vt_turnover_kept(spark, d):
    return _totals(spark, d).turnover(datetime(1996, 2, 11), datetime(1999, 12, 3, 23, 59, 59))


@query("cache_kept", "WITH l AS (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_type, value, ts FROM l WHERE rn = 1 AND ts >= TIMESTAMP '2024-01-27 00:00:00' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 8)")
def cache_kept(spark, d):
    """Two puts, the second with keys of the first; keys invalidated, old ones cleaned, the rest read by the last version."""
    events = Registry(spark, d).table("events")
    cache = Cache(spark, _shared_folder(spark), "user_id BIGINT, event_type STRING, value DOUBLE, ts TIMESTAMP_NTZ", ["user_id"], at="ts", buckets=16)
    rows = events.select("user_id", "event_type", "value", "ts")
    cache.put(rows.where("event_type IN ('click', 'view')"))
    cache.put(rows.where("event_type NOT IN ('click', 'view')"))
    cache.invalidate(events.where("event_type = 'error'").groupBy("user_id").count().where("count > 8"))
    cache.clean(F.lit("2024-01-27").cast("timestamp_ntz"))
    return cache.read()


#: DuckDB's distance counts bytes, so each letter of several bytes is one that no asked word has.
_LENGTH, _FAR = "greatest(strlen(t), strlen(w))", r"levenshtein(regexp_replace(t, '[^\x00-\x7F]', '#', 'g'), w)"
_NEAR = f"CASE WHEN t = w THEN 1.0 WHEN starts_with(t, w) THEN 0.95 WHEN contains(t, w) THEN 0.8 WHEN {_FAR} <= 3 AND 1 - {_FAR} / {_LENGTH} >= 0.6 THEN 1 - {_FAR} / {_LENGTH} END"


@query("fuzzy_vocabulary", f"WITH v AS (SELECT DISTINCT unnest({_terms('text')}) AS t FROM documents), q AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part) SELECT w AS word, t AS term, round(CAST({_NEAR} AS DOUBLE), 6) AS similarity FROM v, q WHERE {_NEAR} IS NOT NULL")
def fuzzy_vocabulary(spark, d):
    """All words of part names looked up among all words of all documents."""
    r = Registry(spark, d)
    vocabulary = r.table("documents").select(F.explode(S.index_terms(F.col("text"))).alias("term")).distinct()
    words = r.table("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return Z.matches(Z.postings(vocabulary), words).select("word", "term", "similarity")


#: A page's place: its host from the end, then its path; every third page's folder is known, and what is two above every fifth.
_PLACE = "'/' || array_to_string(list_reverse(string_split(regexp_extract(url, '^[^:]+://([^/]+)', 1), '.')), '/') || rtrim(regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1), '/')"


@query("path_links", f"""WITH p AS (SELECT DISTINCT {_PLACE} AS path FROM pages), a AS (SELECT {_PLACE} AS path, page_id FROM pages),
 f AS (SELECT folder, folder AS name, string_split(folder, '/')[-1] AS own FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[1:-(CASE WHEN page_id % 3 = 0 THEN 2 ELSE 3 END)], '/') AS folder FROM a WHERE page_id % 3 = 0 OR page_id % 5 = 0) WHERE folder <> ''),
 one AS (SELECT path, arg_max(folder, len(folder)) AS folder FROM p JOIN f ON starts_with(path, folder || '/') GROUP BY path),
 s AS (SELECT path, generate_subscripts(string_split(path, '/')[1:-2], 1) AS depth, unnest(string_split(path, '/')[1:-2]) AS own FROM p WHERE path NOT IN (SELECT path FROM one)),
 two AS (SELECT path, arg_max(g, depth) AS folder FROM s JOIN (SELECT own, min(folder) AS g FROM f GROUP BY own) USING (own) GROUP BY path)
 SELECT path, coalesce(one.folder, two.folder) AS folder, coalesce(one.folder, two.folder) AS name FROM p LEFT JOIN one USING (path) LEFT JOIN two USING (path)""")
def path_links(spark, d):
    """Pages linked to the deepest known folder on their way, or by a folder's name alone."""
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", "^[^:]+://([^/]+)", 1), r"\.")), "/")
    place = F.concat(F.lit("/"), host, F.regexp_replace(F.regexp_extract("url", "^[^:]+://[^/]+(/[^?#]*)", 1), "/+$", ""))
    pages = Registry(spark, d).table("pages").select("page_id", place.alias("path"))
    steps = F.split("path", "/")
    above = F.array_join(F.slice(steps, F.lit(1), F.size(steps) - F.when(F.col("page_id") % 3 == 0, 1).otherwise(2)), "/")
    folders = pages.where("page_id % 3 = 0 OR page_id % 5 = 0").select(above.alias("folder"), above.alias("name"))
    return R.link_by_path(pages, folders)


@query("graph_pairs", "SELECT 'c' || c_custkey AS start, 'r' || c_custkey % 5 AS goal, n_regionkey = c_custkey % 5 AS reaches FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, 'c' || n_nationkey, FALSE FROM nation")
def graph_pairs(spark, d):
    """Whether customers lead to a region, and nations to a customer, told by labels and walks of what these leave open."""
    r = Registry(spark, d)
    name = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    customer, nation = r.table("customer"), r.table("nation")
    edges = customer.select(name("c", F.col("c_custkey")).alias("src"), name("n", F.col("c_nationkey")).alias("dst")).unionByName(nation.select(name("n", F.col("n_nationkey")).alias("src"), name("r", F.col("n_regionkey")).alias("dst")))
    pairs = customer.select(name("c", F.col("c_custkey")).alias("start"), name("r", F.col("c_custkey") % 5).alias("goal"))
    pairs = pairs.unionByName(nation.select(name("n", F.col("n_nationkey")).alias("start"), name("c", F.col("n_nationkey")).alias("goal")))
    return G.reachable(edges, G.reach_labels(edges), pairs)


_NODE = "'c' || lpad(CAST({} AS VARCHAR), 12, '0')"


@query("graph_witness", f"""WITH b AS (SELECT c_custkey AS first, 2 + (c_custkey // 10) % 7 AS last, (c_custkey // 10) % 2 = 0 AS chord FROM customer WHERE c_custkey % 10 = 0)
 SELECT {_NODE.format('first')} AS cycle, CAST(CASE WHEN chord AND k > 1 THEN k - 1 ELSE k END AS INTEGER) AS place, {_NODE.format('first + k')} AS node FROM b, range(9) r(k) WHERE k <= last AND NOT (chord AND k = 1)""")
def graph_witness(spark, d):
    """Chains of ten customers with an edge back, and in every other one an edge that spares a step: a shortest ring of each."""
    name = lambda c: F.concat(F.lit("c"), F.lpad(c.cast("string"), 12, "0"))
    k = F.col("c_custkey")
    c = Registry(spark, d).table("customer").select("c_custkey")
    block, at = F.floor(k / 10), k % 10
    edges = c.where(at < 9).select(name(k).alias("src"), name(k + 1).alias("dst"))
    edges = edges.unionByName(c.where(at == 2 + block % 7).select(name(k).alias("src"), name(block * 10).alias("dst")))
    edges = edges.unionByName(c.where((at == 0) & (block % 2 == 0)).select(name(k).alias("src"), name(k + 2).alias("dst")))
    known = c.select(name(k).alias("dst"))
    return G.witnesses(edges.join(known, "dst", "left_semi").select("src", "dst"))


@query("completion_table", "SELECT w AS beginning, suggestion FROM (SELECT q.w, v.t AS suggestion, row_number() OVER (PARTITION BY q.w ORDER BY v.t) AS k FROM (SELECT DISTINCT unnest(" + _terms("text") + ") AS t FROM documents) v JOIN (VALUES ('th'), ('die'), ('ent'), ('zz')) q(w) ON starts_with(v.t, q.w)) WHERE k <= 10")
def completion_table(spark, d):
    """Four beginnings answered by a kept table of all words of all documents."""
    kept = Completions(spark, _shared_folder(spark))
    kept.build(Registry(spark, d).table("documents").select(F.explode(S.index_terms(F.col("text"))).alias("name")))
    return reduce(DataFrame.unionByName, [kept.first(w).select(F.lit(w).alias("beginning"), "suggestion") for w in ("th", "die", "ent", "zz")])


@query("page_by_position", "SELECT c_custkey, c_acctbal, CAST(t AS BIGINT) AS _total, CAST(ceil(t / 40) AS BIGINT) AS _pages, 4 < ceil(t / 40) AS _has_next, TRUE AS _has_previous FROM (SELECT *, count(*) OVER () AS t FROM customer) ORDER BY c_acctbal, c_custkey LIMIT 40 OFFSET 120")
def page_by_position(spark, d):
    """The fourth page of customers by balance, of which the ranges that hold it are read."""
    kept = Ordered(spark, _shared_folder(spark), "c_custkey BIGINT, c_acctbal DOUBLE", ["c_acctbal", "c_custkey"], ranges=32)
    kept.build(Registry(spark, d).table("customer"))
    return kept.page(3, 40)


_PARTY = "CASE o_orderstatus WHEN 'F' THEN 'customer' WHEN 'O' THEN 'supplier' WHEN 'P' THEN 'firm' END"


@query("ref_tagged", f"SELECT o.o_orderkey, {_PARTY} AS party, coalesce(c.c_name, s.s_name) AS party_name, coalesce(c.c_acctbal, s.s_acctbal) AS party_balance, c.c_mktsegment AS party_segment FROM orders o LEFT JOIN customer c ON {_PARTY} = 'customer' AND c.c_custkey = o.o_custkey LEFT JOIN supplier s ON {_PARTY} = 'supplier' AND s.s_suppkey = o.o_custkey")
def ref_tagged(spark, d):
    """Orders whose other party is a customer, a supplier or a kind that isn't known; some suppliers aren't there."""
    r = Registry(spark, d)
    party = F.when(F.col("o_orderstatus") == "F", "customer").when(F.col("o_orderstatus") == "O", "supplier").when(F.col("o_orderstatus") == "P", "firm")
    orders = r.table("orders").select("o_orderkey", "o_custkey", party.alias("party"))
    found = r.navigate_tagged(orders, "party", "o_custkey", {"customer": {"party_name": "c_name", "party_balance": "c_acctbal", "party_segment": "c_mktsegment"}, "supplier": {"party_name": "s_name", "party_balance": "s_acctbal"}})
    return found.drop("o_custkey")


_TAGS = ("Catalog", "Document", "AccumulationRegister", "Enum")
_KIND = "['Catalog', 'Document', 'Register', 'Enum'][s_suppkey % 4 + 1]"


def _objects(spark, d):
    """A file for each supplier, with comments that look like objects, character data, references, attributes and prefixes; some aren't well-formed."""
    k = F.col("s_suppkey")
    tag = F.element_at(F.array(*map(F.lit, _TAGS)), (k % 4 + 1).cast("int"))
    types = F.slice(F.array(*[F.lit(f"<v8:Type>{t}</v8:Type>") for t in ("xs:string", "cfg:CatalogRef.Goods", "xs:decimal")]), F.lit(1), (k % 4).cast("int"))
    field = lambda what, name, kinds: F.concat(F.lit(f"<{what} uuid='u'><Properties><Name><![CDATA[{name}]]></Name><!-- <Type><v8:Type>xs:boolean</v8:Type></Type> -->"), kinds, F.lit(f"</Properties></{what}>"))
    several = F.when(F.size(types) > 0, F.concat(F.lit("<Type>"), F.array_join(types, ""), F.lit("</Type>"))).otherwise("")
    size = (k % 9 + 1).cast("string")
    own = F.when(k % 4 == 0, F.concat(F.lit("<CodeLength>"), size, F.lit("</CodeLength>"), F.when(k % 8 == 0, "<CodeType>Number</CodeType>").otherwise(""), F.lit("<DescriptionLength>50</DescriptionLength><Hierarchical>"), F.when(k % 3 == 0, "true").otherwise("false"), F.lit("</Hierarchical><Owners>"), F.when(k % 5 < 2, "<Item>Catalog.Firms</Item>").otherwise(""), F.when(k % 5 == 1, "<Item>Catalog.Units</Item>").otherwise(""), F.lit("</Owners>"))).when(k % 4 == 1, F.concat(F.lit("<NumberLength>"), size, F.lit("</NumberLength>"), F.when(k % 3 == 0, "<Posting>Allow</Posting>").otherwise(""))).otherwise("")
    table = F.when(k % 4 == 1, F.concat(F.lit("<TabularSection><Properties><Name>Rows</Name></Properties><ChildObjects>"), field("Attribute", "Cell &lt;1>", several), F.lit("</ChildObjects></TabularSection>"))).otherwise("")
    fields = F.concat(field("Attribute", "First", several), F.when(k % 4 == 2, F.concat(field("Dimension", "Key", F.lit("<Type><v8:Type>xs:string</v8:Type></Type>")), field("Resource", "Sum", F.lit("<Type><v8:Type>xs:decimal</v8:Type></Type>")))).otherwise(""), table)
    text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<MetaDataObject xmlns="http://m" xmlns:v8="http://v8" version="2">\n<!-- <Catalog><Properties><Name>None</Name></Properties></Catalog> -->\n<'), tag, F.lit(' uuid="'), k.cast("string"), F.lit('"><Properties><Name>S&#'), (F.lit(48) + k % 10).cast("string"), F.lit(";"), k.cast("string"), F.lit("</Name>"), own, F.lit("</Properties>\n<ChildObjects>"), fields, F.when(k % 10 == 9, "</Wrong>").otherwise("</ChildObjects>"), F.lit("</"), tag, F.lit("></MetaDataObject>"))
    folder = _shared_folder(spark)
    M.write_files(Registry(spark, d).table("supplier").select(F.concat(F.lit("objects/"), k.cast("string"), F.lit(".xml")).alias("path"), text.alias("content")), folder)
    return X.read_objects(spark, folder)


_FILES = f"(SELECT s_suppkey, 'S' || s_suppkey % 10 || s_suppkey AS owner, {_KIND} AS kind, CASE s_suppkey % 4 WHEN 0 THEN 'Произвольный' WHEN 1 THEN 'Строка' WHEN 2 THEN 'Составной(Строка, СправочникСсылка.Goods)' ELSE 'Составной(Строка, СправочникСсылка.Goods, Число)' END AS type, s_suppkey % 4 > 1 AS is_composite FROM supplier WHERE s_suppkey % 10 <> 9)"


@query("src_xml_native", f"SELECT owner, kind, 'attribute' AS role, '' AS section, 'First' AS name, type, is_composite FROM {_FILES} UNION ALL SELECT owner, kind, r.role, '', r.name, r.type, FALSE FROM {_FILES} f, (VALUES ('dimension', 'Key', 'Строка'), ('resource', 'Sum', 'Число')) r(role, name, type) WHERE s_suppkey % 4 = 2 UNION ALL SELECT owner, kind, 'attribute', 'Rows', 'Cell &lt;1>', type, is_composite FROM {_FILES} WHERE s_suppkey % 4 = 1 UNION ALL SELECT 'bad', NULL, NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 10 = 9")
def src_xml_native(spark, d):
    """Fields of all objects by the XML reader; a row for each file that isn't well-formed. Files are read once, into a table of their objects."""
    found, folder = _objects(spark, d), _shared_folder(spark)
    found.write.parquet(folder)
    objects = spark.read.schema(found.schema).parquet(folder)
    bad = objects.where("bad IS NOT NULL").select(F.lit("bad").alias("owner"))
    return X.attributes(objects).drop("path").unionByName(bad, allowMissingColumns=True)


@query("std_attributes_native", f"""WITH f AS (SELECT *, CAST(s_suppkey % 9 + 1 AS VARCHAR) AS n FROM {_FILES})
 SELECT owner, kind, 'Код' AS name, CASE WHEN s_suppkey % 8 = 0 THEN 'Число(' || n || ', 0)' ELSE 'Строка(' || n || ')' END AS type, FALSE AS mandatory FROM f WHERE kind = 'Catalog'
 UNION ALL SELECT owner, kind, 'Наименование', 'Строка(50)', TRUE FROM f WHERE kind = 'Catalog' UNION ALL SELECT owner, kind, 'Родитель', 'СправочникСсылка.' || owner, FALSE FROM f WHERE kind = 'Catalog' AND s_suppkey % 3 = 0
 UNION ALL SELECT owner, kind, 'Владелец', CASE s_suppkey % 5 WHEN 0 THEN 'СправочникСсылка.Firms' ELSE 'Составной(СправочникСсылка.Firms, СправочникСсылка.Units)' END, TRUE FROM f WHERE kind = 'Catalog' AND s_suppkey % 5 < 2
 UNION ALL SELECT owner, kind, 'Номер', 'Строка(' || n || ')', FALSE FROM f WHERE kind = 'Document' UNION ALL SELECT owner, kind, 'Дата', 'Дата', TRUE FROM f WHERE kind = 'Document' UNION ALL SELECT owner, kind, 'Проведен', 'Булево', FALSE FROM f WHERE kind = 'Document' AND s_suppkey % 3 = 0
 UNION ALL SELECT owner, kind, a.name, a.type, a.must FROM f, (VALUES ('Период', 'ДатаВремя', TRUE), ('Активность', 'Булево', FALSE)) a(name, type, must) WHERE kind = 'Register'""")
def std_attributes_native(spark, d):
    """Standard attributes with lengths, number codes, parents and owners, by each object's own properties."""
    return X.standard_attributes(_objects(spark, d))
