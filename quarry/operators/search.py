"""Weighted full-text and fuzzy search over DataFrames of named rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What cuts words, how long they may be in bytes, and the words left out (told by case as written).
CUTS = r"[\s.,;:!?()\[\]{}]+"
SHORTEST, LONGEST = 2, 50
STOP_WORDS = (
    "и в на с для к от по или но как что это то же не "
    "a an the is at for to of by in on with and or but as"
).split()

#: Fixed values of the fuzzy match: the least similarity, the farthest distance, and the classes' similarity.
LEAST_SIMILARITY, FARTHEST = 0.6, 3
PREFIX_SIMILARITY, CONTAINS_SIMILARITY = 0.95, 0.8


def tokenize(text: Column) -> Column:
    """The words of a text, as written."""
    return F.filter(F.split(text, CUTS), lambda w: w != "")


def index_terms(text: Column) -> Column:
    """The words that are indexed: of fit byte length, no stop word, in lower case."""
    fit = F.filter(tokenize(text), lambda w: F.octet_length(w).between(SHORTEST, LONGEST) & ~w.isin(STOP_WORDS))
    return F.transform(fit, F.lower)


def postings(rows: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """doc_id, term, weight and position: one row per occurrence, each field with its weight."""
    fields = F.array(*[F.struct(F.lit(float(w)).alias("weight"), index_terms(F.col(c)).alias("terms")) for c, w in weights.items()])
    each = rows.select(F.col(key).alias("doc_id"), F.explode(fields).alias("f"))
    return each.select("doc_id", "f.weight", F.posexplode("f.terms").alias("position", "term")).select("doc_id", "term", "weight", "position")


def search_exact(index: DataFrame, words: list[str]) -> DataFrame:
    """doc_id and score: the posting weights of all query words, a repeated word counted again."""
    asked = {w.lower(): 0 for w in words}
    for w in words:
        asked[w.lower()] += 1
    times = F.create_map(*[x for w, n in asked.items() for x in (F.lit(w), F.lit(float(n)))])
    hits = index.where(F.col("term").isin(list(asked)))
    return hits.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.try_element_at(times, F.col("term"))), 6).alias("score"))


def search_rows(rows: DataFrame, key: str, weights: dict[str, float], words: list[str]) -> DataFrame:
    """``search_exact`` without an index: terms are filtered and counted within their array, so no other word becomes a row."""
    asked = {w.lower(): 0 for w in words}
    for w in words:
        asked[w.lower()] += 1
    times = F.create_map(*[x for w, n in asked.items() for x in (F.lit(w), F.lit(float(n)))])
    total, held = F.lit(0.0), F.lit(0)
    for c, w in weights.items():
        hits = F.filter(index_terms(F.coalesce(F.col(c), F.lit(""))), lambda t: t.isin(list(asked)))
        total = total + F.lit(float(w)) * F.aggregate(hits, F.lit(0.0), lambda a, t: a + F.try_element_at(times, t))
        held = held + F.size(hits)
    return rows.select(F.col(key).alias("doc_id"), total.alias("_s"), held.alias("_h")).where("_h > 0").groupBy("doc_id").agg(F.round(F.sum("_s"), 6).alias("score"))


def similarity(term: Column, word: Column, bytes_length: bool = True) -> Column:
    """1 for equal (whatever the case), 0.95 for a prefix, 0.8 for a part, else 1 - distance / length; null if too far.

    The distance counts characters; with ``bytes_length`` the length counts UTF-8 bytes, else characters.
    """
    a, b = F.lower(term), F.lower(word)
    size = F.octet_length if bytes_length else F.length
    distance = F.levenshtein(a, b, FARTHEST)
    near = 1 - distance / F.greatest(size(a), size(b))
    return F.when(a == b, 1.0).when(a.startswith(b), PREFIX_SIMILARITY).when(a.contains(b), CONTAINS_SIMILARITY).when((distance >= 0) & (near >= LEAST_SIMILARITY), near)


def match_class(term: Column, word: Column) -> Column:
    a, b = F.lower(term), F.lower(word)
    return F.when(a == b, "exact").when(a.startswith(b), "prefix").when(a.contains(b), "contains").when(similarity(term, word).isNotNull(), "fuzzy")


def fuzzy_matches(terms: DataFrame, word: str, term: str = "term") -> DataFrame:
    """The distinct terms near one word, with class and similarity, best first."""
    w = F.lit(word)
    found = terms.select(F.col(term).alias("term")).distinct().select("term", match_class(F.col("term"), w).alias("class"), F.round(similarity(F.col("term"), w), 6).alias("similarity"))
    return found.where("similarity IS NOT NULL").orderBy(F.desc("similarity"), "term")


def search_fuzzy(index: DataFrame, words: list[str], most: int = 5, damp: float = 0.7) -> DataFrame:
    """doc_id and score by the ``most`` nearest index terms of each word: weight times similarity, damped."""
    terms = index.select("term").distinct()
    near = None
    for w in dict.fromkeys(words):
        found = fuzzy_matches(terms, w).limit(most).select("term", F.lit(w).alias("word"), "similarity")
        near = found if near is None else near.union(found)
    hits = index.join(F.broadcast(near), "term")  # at most ``most`` rows a word
    return hits.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("similarity")) * damp, 6).alias("score"))


def search(index: DataFrame, words: list[str], fuzzy: bool = True, enough: int = 10) -> DataFrame:
    """Exact scores; where fewer than ``enough`` documents match and ``fuzzy`` is set, fuzzy ones are added."""
    exact = search_exact(index, words)
    if not fuzzy or exact.limit(enough).count() >= enough:
        return exact
    both = exact.union(search_fuzzy(index, words))
    return both.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


def highlight(text: Column, words: list[str], mark: str = "mark") -> Column:
    """The text with every occurrence of the first query word that it holds, as written, in marks."""
    out = text
    for w in reversed(words):
        out = F.when(text.contains(w), F.replace(text, F.lit(w), F.lit(f"<{mark}>{w}</{mark}>"))).otherwise(out)
    return out


def highlight_term(term: Column, word: Column, mark: str = "mark") -> Column:
    """The term with its prefix or part that equals the word in marks; a fuzzy match is marked whole."""
    at = F.instr(F.lower(term), F.lower(word))
    n = F.length(word)
    inner = F.concat(F.substring(term, F.lit(1), at - 1), F.lit(f"<{mark}>"), F.substring(term, at, n), F.lit(f"</{mark}>"), F.substring(term, at + n, F.length(term)))
    return F.when(at > 0, inner).otherwise(F.concat(F.lit(f"<{mark}>"), term, F.lit(f"</{mark}>")))


def page(rows: DataFrame, number: int, size: int, order: list[Column], first: int = 0, total: int | None = None) -> DataFrame:
    """One page of a total order with _total, _pages, _has_next and _has_previous.

    Pages count from ``first`` (0 or 1). Numbering beyond the end gives no rows. ``total`` spares
    the count where it is known from an earlier page.
    """
    if number < first or size < 1:
        raise ValueError("no such page")
    k = number - first
    total = rows.count() if total is None else total
    pages = -(-total // size)
    part = rows.orderBy(*order).offset(k * size).limit(size)
    about = {"_total": total, "_pages": pages}
    return part.select("*", *[F.lit(v).cast("long").alias(n) for n, v in about.items()], F.lit(k + 1 < pages).alias("_has_next"), F.lit(k > 0).alias("_has_previous"))


def suggest(terms: DataFrame, prefix: str, term: str = "term", most: int = 10) -> DataFrame:
    """The first distinct terms with this beginning; none for a beginning under two bytes."""
    found = terms.select(F.lower(term).alias("suggestion")).where(F.col("suggestion").startswith(prefix.lower()))
    return found.where(F.lit(len(prefix.encode()) >= 2)).distinct().orderBy("suggestion").limit(most)


def facet_counts(rows: DataFrame, facets: str) -> DataFrame:
    return rows.select(F.explode(facets).alias("facet")).groupBy("facet").agg(F.count(F.lit(1)).alias("n"))
