"""Benchmark passages in training documents, by a positional inverted index of the documents' words.

The index has a posting (document, position, term) for each word of a document that is a word of
the benchmark at all. A window of benchmark words is looked up from its two rarest words: their
lists, moved by the words' places in the window, are intersected; what is left meets the lists of
all its words. All words at their places are an occurrence of the phrase; its two rarest words and
most of the others near their places are a proximity match.

Words are lower-cased in A to Z only and split at ASCII characters other than letters and digits.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rows of test terms, test windows or found documents that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 1 << 18


@dataclass(frozen=True)
class Settings:
    """window: words of a window; slack: words that a word may be off its place in a proximity match;
    least: per cent of a window's words that such a match needs near their places."""

    window: int = 10
    slack: int = 2
    least: int = 80


def split_words(text: Column) -> Column:
    """The words, with an empty string where the text begins or ends with what is no word; [''] for no text."""
    return F.split(F.translate(text, UPPER, LOWER), NOT_WORD)


def _sized(df: DataFrame) -> DataFrame:
    """A scratch table, marked for broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def test_windows(benchmark: DataFrame, settings: Settings, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct word lists of items (_list, its item ids as strings, null as ``null``), and distinct windows (_window, _words, the lists that hold it)."""
    words = F.filter(split_words(whole(text)), lambda w: w != "")
    said = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("_item"), words.alias("_words")).where("size(_words) > 0")
    lists = materialize(said.groupBy("_words").agg(F.collect_set("_item").alias("_items")).select(F.monotonically_increasing_id().alias("_list"), "*"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_words") - settings.window + 1))
    cut = lists.select("_list", "_words", F.explode(starts).alias("_at")).select("_list", F.slice("_words", F.col("_at"), settings.window).alias("_words"))
    windows = materialize(cut.groupBy("_words").agg(F.collect_set("_list").alias("_lists")).select(F.monotonically_increasing_id().alias("_window"), "*"))
    return lists, windows


def build_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings _key, _hash, _pos, _term of the words in ``terms`` (_word, _term), written as a scratch table.

    A document is known by its key and the hash of its text; rows of one key and text are one
    document. Each row of ``docs`` also has a row at position 0 with its null-safe key and n_words,
    whose term may be null.
    """
    words = split_words(F.col("_text"))
    first, last, size = F.col("_all")[0], F.element_at("_all", -1), F.size("_all")
    cut = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), whole(text).alias("_text")).select("doc_id", F.xxhash64("_text").alias("_hash"), words.alias("_all"))
    counted = cut.select("doc_id", "_hash", "_all", (size - (first == "").cast("int") - ((last == "") & (size > 1)).cast("int")).cast("bigint").alias("n_words"))
    rows = counted.select("doc_id", "_hash", "n_words", F.posexplode("_all").alias("_pos", "_word"))
    found = rows.join(_sized(terms), "_word", "left").where("_term IS NOT NULL OR _pos = 0")
    return materialize(found.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("_key"), "_hash", "_pos", "_term", F.when(F.col("_pos") == 0, F.col("n_words")).alias("n_words")))


def _ranked(windows: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """Windows whose words all occur in the documents: _window, _size and _parts (n, offset, term of each word, rarest first)."""
    counts = _sized(materialize(index.where("_term IS NOT NULL").groupBy("_term").agg(F.count(F.lit(1)).alias("_n"))))
    parts = windows.select("_window", F.size("_words").alias("_size"), F.posexplode("_words").alias("_offset", "_word")).join(terms, "_word").join(counts, "_term")
    ranked = parts.groupBy("_window", "_size").agg(F.sort_array(F.collect_list(F.struct("_n", "_offset", "_term"))).alias("_parts"))
    return materialize(ranked.where("size(_parts) = _size"))


def _near(asked: DataFrame, postings: DataFrame, slack: int) -> DataFrame:
    """``asked`` (_key, _hash, _want, _term, ...) with the postings of that document and term within ``slack`` positions: _off is how far off they are.

    Positions are cut into cells of 2 * slack + 1, of which a span of ``slack`` to either side meets two at most.
    """
    width = 2 * slack + 1
    cell = lambda p: F.floor(p / width).cast("int")
    span = F.array_distinct(F.array(cell(F.col("_want") - slack), cell(F.col("_want") + slack)))
    spread = asked.select("*", F.explode(span).alias("_cell"))
    return spread.join(postings.select("_key", "_hash", "_term", cell(F.col("_pos")).alias("_cell"), "_pos"), ["_key", "_hash", "_term", "_cell"]).where(F.abs(F.col("_pos") - F.col("_want")) <= slack).withColumn("_off", F.col("_pos") - F.col("_want"))


def matches(index: DataFrame, ranked: DataFrame, settings: Settings) -> DataFrame:
    """_key, _hash, _window, _size, _start and _exact of each place where a window's words stand, or most of them nearly.

    Start positions are those that the rarest word tells. Every list is whole: a frequent word has
    a long one, which a window of rarer words never reads but for the documents left.
    """
    postings = index.where("_term IS NOT NULL").select("_key", "_hash", "_pos", "_term")
    part = lambda k, name: F.col("_parts")[k][name]
    alone = ranked.where("_size = 1").select("_window", "_size", part(0, "_term").alias("_term"))
    single = postings.join(_sized(alone), "_term").select("_key", "_hash", "_window", "_size", F.col("_pos").alias("_start"), F.lit(True).alias("_exact"))
    # Windows that share their two rarest words at one distance are looked up as one.
    asked = ranked.where("_size > 1").select("_window", "_size", part(0, "_term").alias("_first"), part(0, "_offset").alias("_offset"), part(1, "_term").alias("_second"), (part(1, "_offset") - part(0, "_offset")).alias("_apart"))
    pairs = materialize(asked.select("_first", "_second", "_apart").distinct())
    begun = postings.join(_sized(pairs), F.col("_term") == F.col("_first")).select("_key", "_hash", F.col("_pos").alias("_from"), "_first", "_apart", F.col("_second").alias("_term"), (F.col("_pos") + F.col("_apart")).alias("_want"))
    seconds = pairs.select(F.col("_second").alias("_term")).distinct()
    met = _near(begun, postings.join(_sized(seconds), "_term", "left_semi"), settings.slack).select("_key", "_hash", "_from", "_first", "_apart", F.col("_term").alias("_second")).distinct()
    left = materialize(met.join(_sized(asked), ["_first", "_second", "_apart"]).select("_key", "_hash", "_window", "_size", (F.col("_from") - F.col("_offset")).alias("_start")))
    there = postings.join(_sized(materialize(left.select("_key", "_hash").distinct())), ["_key", "_hash"], "left_semi")
    wanted = left.join(_sized(ranked.select("_window", "_parts")), "_window").select("_key", "_hash", "_window", "_size", "_start", F.explode("_parts").alias("_part"))
    found = _near(wanted.select("*", F.col("_part._term").alias("_term"), F.col("_part._offset").alias("_offset"), (F.col("_start") + F.col("_part._offset")).alias("_want")), there, settings.slack)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_offset"))
    masks = found.groupBy("_key", "_hash", "_window", "_size", "_start").agg(F.bit_or(F.when(F.col("_off") == 0, bit)).alias("_same"), F.bit_or(bit).alias("_close"))
    judged = masks.withColumn("_exact", F.coalesce(F.bit_count("_same") == F.col("_size"), F.lit(False)))
    return single.unionByName(judged.where(F.col("_exact") | (F.bit_count("_close") * 100 >= F.col("_size") * settings.least)).drop("_same", "_close"))


def check(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    A window is ``settings.window`` consecutive words of an item, or all words of a shorter one.
    n_hit counts the document's words inside occurrences, n_items the items (by id) with an
    occurring window, n_near_items those with a proximity match or an occurrence. Null and empty
    texts have no words; a benchmark without words leaves all clean; repeated items and ids count
    once, a null id is the string ``null``; repeated documents get equal rows.
    """
    settings = settings or Settings()
    if not 1 <= settings.window <= 62:
        raise ValueError("a window has from 1 to 62 words")
    lists, windows = test_windows(benchmark, settings, item, item_text)
    terms = materialize(windows.select(F.explode("_words").alias("_word")).distinct().select("_word", F.monotonically_increasing_id().alias("_term")))
    index = build_index(docs, terms, key, text)
    found = materialize(matches(index, _ranked(windows, terms, index), settings))
    before = "OVER (PARTITION BY _key, _hash ORDER BY _start, _stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    spans = found.where("_exact").groupBy("_key", "_hash", "_start").agg((F.col("_start") + F.max("_size")).alias("_stop"))
    fresh = spans.selectExpr("_key", "_hash", f"greatest(0, _stop - greatest(_start, coalesce(max(_stop) {before}, 0))) AS _new")
    hits = fresh.groupBy("_key", "_hash").agg(F.sum("_new").alias("n_hit"))
    held = found.groupBy("_key", "_hash", "_window").agg(F.max("_exact").alias("_exact")).join(windows.select("_window", "_lists"), "_window")
    of_list = held.select("_key", "_hash", "_exact", F.explode("_lists").alias("_list")).groupBy("_key", "_hash", "_list").agg(F.max("_exact").alias("_exact"))
    named = of_list.join(lists.select("_list", "_items"), "_list").groupBy("_key", "_hash")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    items = named.agg(union(F.when(F.col("_exact"), F.col("_items"))).alias("_exactly"), F.size(union(F.col("_items"))).cast("bigint").alias("n_near_items"))
    result = hits.join(items, ["_key", "_hash"], "full")
    rows = index.where("_pos = 0").select("doc_id", "_key", "_hash", "n_words")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    exactly = F.coalesce("_exactly", F.array().cast("array<string>"))
    return rows.join(_sized(materialize(result)), ["_key", "_hash"], "left").select(
        "doc_id", "n_words", zero(F.col("n_hit")).alias("n_hit"), F.size(exactly).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(exactly, ",").cast("binary"), 256).alias("items_sha256"), (zero(F.col("n_hit")) > 0).alias("contaminated"), zero(F.col("n_near_items")).alias("n_near_items"),
    )
