"""Full-text and fuzzy search over ``documents`` and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.sources.registry import Registry

from .base import query

_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "]"


def _terms(column: str) -> str:
    return rf"list_transform(list_filter(regexp_split_to_array({column}, '[\s.,;:!?()\[\]{{}}]+'), lambda w: w <> '' AND strlen(w) BETWEEN 2 AND 50 AND NOT list_contains({_STOP}, w)), lambda w: lower(w))"


def _postings(source: str, key: str, weights: dict[str, float]) -> str:
    parts = [f"SELECT {key} AS doc_id, unnest({_terms(c)}) AS term, CAST({w} AS DOUBLE) AS weight, unnest(range(len({_terms(c)}))) AS position FROM {source}" for c, w in weights.items()]
    return "(" + " UNION ALL ".join(parts) + ")"


_DOCS = _postings("documents", "doc_id", {"text": 1.0, "source": 2.0})
_PARTS = _postings("part", "p_partkey", {"p_name": 3.0, "p_type": 2.0, "p_brand": 1.0})


def _parts(spark, d):
    return S.postings(Registry(spark, d).table("part"), "p_partkey", {"p_name": 3.0, "p_type": 2.0, "p_brand": 1.0})


_WEIGHTS = {"text": 1.0, "source": 2.0}


def _documents(spark, d):
    return S.postings(Registry(spark, d).table("documents"), "doc_id", _WEIGHTS)


@query("tokenize", r"SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[\s.,;:!?()\[\]{}]+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def tokenize(spark, d):
    return Registry(spark, d).table("documents").select(F.explode(S.tokenize(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("token_filter", f"SELECT doc_id, CAST(len({_terms('text')}) AS INTEGER) AS terms FROM documents")
def token_filter(spark, d):
    return Registry(spark, d).table("documents").select("doc_id", F.size(S.index_terms(F.col("text"))).alias("terms"))


@query("index_postings", f"SELECT doc_id, term, weight, CAST(position AS INTEGER) AS position FROM {_PARTS}")
def index_postings(spark, d):
    return _parts(spark, d)


def _exact(index: str, words: list[str]) -> str:
    asked = " UNION ALL ".join(f"SELECT '{w}' AS w" for w in words)
    return f"SELECT doc_id, round(sum(weight), 6) AS score FROM {index} JOIN ({asked}) ON term = w GROUP BY doc_id"


@query("search_exact", _exact(_DOCS, ["with", "ened", "ened", "src3"]))
def search_exact(spark, d):
    return S.search_rows(Registry(spark, d).table("documents"), "doc_id", _WEIGHTS, ["with", "ened", "Ened", "src3"])


_SIM = "CASE WHEN lower(t) = '{w}' THEN 1.0 WHEN starts_with(lower(t), '{w}') THEN 0.95 WHEN contains(lower(t), '{w}') THEN 0.8 WHEN levenshtein(lower(t), '{w}') <= 3 AND 1 - levenshtein(lower(t), '{w}') / greatest(strlen(lower(t)), strlen('{w}')) >= 0.6 THEN 1 - levenshtein(lower(t), '{w}') / greatest(strlen(lower(t)), strlen('{w}')) END"


def _near(index: str, words: list[str], most: int = 5) -> str:
    return " UNION ALL ".join(f"(SELECT t AS term, '{w}' AS word, round(CAST({_SIM.format(w=w)} AS DOUBLE), 6) AS similarity FROM (SELECT DISTINCT term AS t FROM {index}) WHERE {_SIM.format(w=w)} IS NOT NULL ORDER BY similarity DESC, t LIMIT {most})" for w in words)


_FUZZY = f"SELECT doc_id, round(sum(weight * similarity) * 0.7, 6) AS score FROM {_PARTS} p JOIN ({_near(_PARTS, ['rng', 'blts'])}) n ON p.term = n.term GROUP BY doc_id"


@query("search_fuzzy", _FUZZY)
def search_fuzzy(spark, d):
    return S.search_fuzzy(_parts(spark, d), ["rng", "blts"])


@query("search_rank", f"SELECT doc_id, score FROM ({_exact(_DOCS, ['erth', 'the'])}) ORDER BY score DESC, doc_id LIMIT 20")
def search_rank(spark, d):
    return S.search_rows(Registry(spark, d).table("documents"), "doc_id", _WEIGHTS, ["erth", "the"]).orderBy(F.desc("score"), "doc_id").limit(20)


@query("levenshtein", "SELECT DISTINCT p_name, CAST(levenshtein(lower(p_name), 'red widget') AS INTEGER) AS distance FROM part")
def levenshtein(spark, d):
    return Registry(spark, d).table("part").select("p_name", F.levenshtein(F.lower("p_name"), F.lit("red widget")).alias("distance")).distinct()


@query("fuzzy_match", f"SELECT DISTINCT t AS p_name, round(CAST({_SIM.format(w='small')} AS DOUBLE), 6) AS similarity FROM (SELECT p_name AS t FROM part)")
def fuzzy_match(spark, d):
    return Registry(spark, d).table("part").select("p_name").distinct().select("p_name", F.round(S.similarity(F.col("p_name"), F.lit("small")), 6).alias("similarity"))


@query("fuzzy_matches", f"SELECT t AS term, CASE WHEN lower(t) = 'bolt' THEN 'exact' WHEN starts_with(lower(t), 'bolt') THEN 'prefix' WHEN contains(lower(t), 'bolt') THEN 'contains' ELSE 'fuzzy' END AS class, round(CAST({_SIM.format(w='bolt')} AS DOUBLE), 6) AS similarity FROM (SELECT DISTINCT term AS t FROM {_PARTS}) WHERE {_SIM.format(w='bolt')} IS NOT NULL")
def fuzzy_matches(spark, d):
    return S.fuzzy_matches(_parts(spark, d), "bolt")


@query("highlight_term", "SELECT DISTINCT p_name, CASE WHEN instr(lower(p_name), 'ring') > 0 THEN left(p_name, instr(lower(p_name), 'ring') - 1) || '<mark>' || substr(p_name, instr(lower(p_name), 'ring'), 4) || '</mark>' || substr(p_name, instr(lower(p_name), 'ring') + 4) ELSE '<mark>' || p_name || '</mark>' END AS marked FROM part")
def highlight_term(spark, d):
    return Registry(spark, d).table("part").select("p_name").distinct().select("p_name", S.highlight_term(F.col("p_name"), F.lit("ring")).alias("marked"))


@query("highlight_doc", "SELECT doc_id, CASE WHEN contains(text, 'zzz') THEN replace(text, 'zzz', '<mark>zzz</mark>') WHEN contains(text, 'the') THEN replace(text, 'the', '<mark>the</mark>') ELSE text END AS marked FROM documents")
def highlight_doc(spark, d):
    return Registry(spark, d).table("documents").select("doc_id", S.highlight(F.col("text"), ["zzz", "the"]).alias("marked"))


@query("suggest", f"SELECT DISTINCT lower(term) AS suggestion FROM {_PARTS} WHERE starts_with(lower(term), 'br') ORDER BY suggestion LIMIT 10")
def suggest(spark, d):
    return S.suggest(_parts(spark, d), "br")


#: Terms that are suggested for a query that they hold.
POPULAR = ("ТаблицаЗначений", "Справочники", "Документы", "СписокЗначений")


@query("suggest_static", "SELECT r_regionkey, array_to_string(list_filter(['ТаблицаЗначений', 'Справочники', 'Документы', 'СписокЗначений'], lambda s: contains(lower(s), q)), ',') AS suggestions FROM (SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'знач' WHEN 1 THEN 'док' ELSE 'спр' END AS q FROM region)")
def suggest_static(spark, d):
    asked = F.when(F.col("r_regionkey") == 0, "знач").when(F.col("r_regionkey") == 1, "док").otherwise("спр")
    found = F.filter(F.array(*map(F.lit, POPULAR)), lambda s: F.lower(s).contains(F.lower(F.col("q"))))
    return Registry(spark, d).table("region").withColumn("q", asked).select("r_regionkey", F.array_join(found, ",").alias("suggestions"))


@query("paginate0", "SELECT c_custkey, CAST(t AS BIGINT) AS _total, CAST(ceil(t / 50) AS BIGINT) AS _pages, 3 < ceil(t / 50) AS _has_next, TRUE AS _has_previous FROM (SELECT *, count(*) OVER () AS t FROM customer) ORDER BY c_custkey LIMIT 50 OFFSET 100")
def paginate0(spark, d):
    return S.page(Registry(spark, d).table("customer").select("c_custkey"), 2, 50, [F.col("c_custkey")])


@query("paginate1", "SELECT s_suppkey, CAST(t AS BIGINT) AS _total, CAST(ceil(t / 7) AS BIGINT) AS _pages, 1 < ceil(t / 7) AS _has_next, FALSE AS _has_previous FROM (SELECT *, count(*) OVER () AS t FROM supplier) ORDER BY s_suppkey LIMIT 7")
def paginate1(spark, d):
    return S.page(Registry(spark, d).table("supplier").select("s_suppkey"), 1, 7, [F.col("s_suppkey")], first=1)


@query("sort_results", f"SELECT doc_id, p_name FROM ({_exact(_PARTS, ['ring'])}) JOIN part ON p_partkey = doc_id ORDER BY p_name DESC, doc_id")
def sort_results(spark, d):
    found = S.search_exact(_parts(spark, d), ["ring"])
    return found.join(Registry(spark, d).table("part"), F.col("doc_id") == F.col("p_partkey")).select("doc_id", "p_name").orderBy(F.desc("p_name"), "doc_id")


_FOUND = f"(SELECT doc_id, score, p_name, p_type FROM ({_exact(_PARTS, ['ring', 'red'])}) JOIN part ON p_partkey = doc_id WHERE p_type IN ('ECONOMY', 'SMALL'))"


@query("search_pipeline", f"SELECT f.doc_id, f.score, f.p_name, c.n AS in_category FROM {_FOUND} f JOIN (SELECT p_type, count(*) AS n FROM {_FOUND} GROUP BY p_type) c ON f.p_type = c.p_type ORDER BY f.score DESC, f.doc_id LIMIT 25")
def search_pipeline(spark, d):
    """Scores, a category filter, true facet counts of the result, and the first page by score."""
    part = Registry(spark, d).table("part").where(F.col("p_type").isin("ECONOMY", "SMALL"))
    found = S.search(_parts(spark, d), ["ring", "red"]).join(part, F.col("doc_id") == F.col("p_partkey")).select("doc_id", "score", "p_name", "p_type")
    counts = found.groupBy("p_type").agg(F.count(F.lit(1)).alias("in_category"))
    return found.join(counts, "p_type").select("doc_id", "score", "p_name", "in_category").orderBy(F.desc("score"), "doc_id").limit(25)


@query("search_options", f"SELECT doc_id, score FROM ({_exact(_DOCS, ['ened'])}) WHERE score >= 2 ORDER BY score DESC, doc_id LIMIT 15")
def search_options(spark, d):
    """A least score, a most of results and a second term of order."""
    return S.search_rows(Registry(spark, d).table("documents"), "doc_id", _WEIGHTS, ["ened"]).where("score >= 2").orderBy(F.desc("score"), "doc_id").limit(15)
