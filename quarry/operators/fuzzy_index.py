"""Words near a word, over a large vocabulary, without a distance for each pair.

How many edits a pair may have hangs on its length: a similarity of 0.6 allows none, one, two or,
from eight bytes on, three. Of a term cut into one segment more than that, one stays whole, and the
place to which it moves is bound by its own place and by the difference of the lengths. So terms
are posted by segments under their lengths, in characters and in bytes beyond them, once for each
number of edits they may take part with; a word asks for its own pieces of these sizes at these
places. Parts of terms (equal words and beginnings are parts) are posted by grams: a word asks for
one gram of its own. What is found so is then compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search as S

#: The longest gram, and bytes that an edit may add or take beyond its characters.
GRAM, WIDEST = 3, 3

#: Asked words that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 16


def _cut(length: Column, k: Column, edits: Column) -> tuple[Column, Column]:
    """Start (from 1) and size of segment ``k`` of edits + 1: the last ones take what doesn't divide."""
    n = edits + 1
    size, rest = F.floor(length / n).cast("int"), (length % n).cast("int")
    late = F.greatest(F.lit(0), k - (n - rest))
    return k * size + late + 1, size + (k >= n - rest).cast("int")


def _key(edits: Column, length: Column, extra: Column, k: Column, text: Column) -> Column:
    return F.concat_ws("/", F.lit("s"), *[c.cast("string") for c in (edits, length, extra, k)], text)


def _edits(most_bytes: Column) -> Column:
    """Edits that a pair may have whose longer word has so many bytes."""
    return F.least(F.lit(S.FARTHEST), F.floor((1 - F.lit(S.LEAST_SIMILARITY)) * most_bytes + 1e-9).cast("int"))


def postings(terms: DataFrame, term: str = "term") -> DataFrame:
    """key and term: the keys of each distinct term: its segments for every number of edits from its own length's on, and its grams of one to three characters."""
    told = terms.select(F.col(term).alias("term")).where("term IS NOT NULL AND term <> ''").distinct().withColumn("_l", F.lower("term"))
    n, extra = F.length("_l"), F.octet_length("_l") - F.length("_l")
    cuts = F.sequence(F.greatest(F.lit(1), _edits(F.octet_length("_l"))), F.lit(S.FARTHEST))
    of = lambda edits: F.transform(F.sequence(F.lit(0), edits), lambda k: _key(edits, n, extra, k, F.substring("_l", *_cut(n, k, edits))))
    starts = F.sequence(F.lit(1), n)
    grams = F.flatten(F.transform(F.array(*map(F.lit, range(1, GRAM + 1))), lambda g: F.transform(F.filter(starts, lambda s: s + g - 1 <= n), lambda s: F.concat(F.lit("g/"), F.substring("_l", s, g)))))
    return told.select("term", F.explode(F.array_distinct(F.concat(F.flatten(F.transform(cuts, of)), grams))).alias("key"))


def asked_keys(words: DataFrame, word: str = "word") -> DataFrame:
    """key and word: what each distinct word asks for."""
    told = words.select(F.col(word).alias("word")).where("word IS NOT NULL AND word <> ''").distinct().withColumn("_l", F.lower("word"))
    n, extra = F.length("_l"), F.octet_length("_l") - F.length("_l")
    reach, wide = S.FARTHEST, S.FARTHEST * WIDEST
    lengths = F.explode(F.sequence(F.greatest(F.lit(1), n - reach), n + reach)).alias("_n")
    shapes = told.select("word", "_l", lengths).select("*", F.explode(F.sequence(F.greatest(F.lit(0), extra - wide), extra + wide)).alias("_e"))
    shapes = shapes.where(F.col("_e") <= WIDEST * F.col("_n")).withColumn("_t", _edits(F.greatest(F.octet_length("_l"), F.col("_n") + F.col("_e"))))
    # No pair differs by more characters than edits, nor by more bytes than these can bring.
    apart = n - F.col("_n")
    shapes = shapes.where((F.col("_t") > 0) & (F.abs(apart) <= F.col("_t")) & (F.abs(extra - F.col("_e")) <= WIDEST * F.col("_t")))

    def of_segment(k: Column) -> Column:
        start, size = _cut(F.col("_n"), k, F.col("_t"))
        low, high = F.greatest(-k, apart - (F.col("_t") - k), 1 - start), F.least(k, apart + (F.col("_t") - k), n - size + 1 - start)
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda s: _key(F.col("_t"), F.col("_n"), F.col("_e"), k, F.substring("_l", start + s, size)))).otherwise(F.array().cast("array<string>"))

    segments = shapes.select("word", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("_t")), of_segment))).alias("key"))
    gram = told.select("word", F.concat(F.lit("g/"), F.substring("_l", F.lit(1), F.least(n, F.lit(GRAM)))).alias("key"))
    return segments.unionByName(gram).distinct()


def candidates(index: DataFrame, words: DataFrame, word: str = "word") -> DataFrame:
    """word and term: pairs that share a key. ``index`` is what ``postings`` gave, kept or not."""
    asked = asked_keys(words, word)
    few = words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return index.join(F.broadcast(asked) if few else asked, "key").select("word", "term").distinct()


def matches(index: DataFrame, words: DataFrame, word: str = "word") -> DataFrame:
    """word, term, class and similarity of all terms near each word: what ``search.similarity`` gives for all pairs."""
    a, b = F.col("term"), F.col("word")
    near = candidates(index, words, word).select("word", "term", S.match_class(a, b).alias("class"), F.round(S.similarity(a, b), 6).alias("similarity"))
    return near.where("similarity IS NOT NULL")
