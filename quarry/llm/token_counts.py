"""Token counts without token ids: pieces are counted once for each distinct pre-token.

The few most frequent pre-tokens, which make up most of any corpus, are joined by broadcast (their
number and length are bounded); the long rest is joined by a shuffle of what the first join left.
Texts with characters that are newer than the JVM are split by the library instead, text by text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, materialize, whole
from .tokens import tokenizer_path

#: Unicode white space, spelled out for Java's patterns.
BLANK = r"\t-\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The published split of byte-level BPE, over that white space.
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"

#: At most so many pre-tokens are broadcast; longer ones than this are joined by a name of 66 letters and digits.
BROADCAST_ROWS, LONG_BYTES = 1 << 19, 64

#: Characters that the JVM's Unicode tables don't know; the library's may, so texts with them are its.
UNKNOWN = r"\p{Cn}"


def special_strings(tokenizer: str) -> list[str]:
    """Strings that the library takes out of a text before it splits the rest."""
    with open(tokenizer_path(tokenizer), encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def pre_tokens(text: Column, specials: list[str], pattern: str = BYTE_LEVEL) -> Column:
    """The text's pre-tokens in order; special strings cut the text and are left out."""
    if not specials:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.flatten(F.transform(F.split(text, "|".join(map(_quoted, specials))), lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(0))))


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    claim()
    model = Tokenizer.from_file(tokenizer_path(tokenizer)).model
    level = _byte_letters()
    for batch in batches:
        pieces = [len(model.tokenize("".join(map(level.__getitem__, w.encode())))) for w in batch.column("pre_token").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("pre_token"), batch.column("uses"), pa.array(pieces, pa.int32())], names=["pre_token", "uses", "pieces"])


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if it shows, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else more))
        more += b not in shown
    return out


def _named(pre_token: Column) -> Column:
    """The pre-token, or for a long one its SHA-256, which mixes letters and digits as no pre-token does."""
    return F.when(F.octet_length(pre_token) > LONG_BYTES, F.concat(F.lit("a1"), F.sha2(pre_token.cast("binary"), 256))).otherwise(pre_token)


def vocabulary(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """pre_token, uses and pieces: each distinct pre-token of all texts, counted by the library's model once."""
    words = docs.select(F.explode(pre_tokens(whole(text), special_strings(tokenizer))).alias("pre_token"))
    counted = words.groupBy("pre_token").agg(F.count(F.lit(1)).alias("uses"))
    return counted.mapInArrow(lambda batches: _count(batches, tokenizer), "pre_token string, uses long, pieces int")


def _count_texts(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """The same by the library's own split: each distinct pre-token is counted once while it is remembered."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    claim()
    library = Tokenizer.from_file(tokenizer_path(tokenizer))
    known: dict[str, int] = {}
    specials = special_strings(tokenizer)
    cut = re.compile("|".join(map(re.escape, specials))).split if specials else lambda t: [t]
    for batch in batches:
        counts = []
        for text in batch.column("_text").to_pylist():
            parts = cut(text)
            total = len(parts) - 1
            for part in parts:
                for piece, _ in library.pre_tokenizer.pre_tokenize_str(part):
                    if piece not in known:
                        if len(known) >= BROADCAST_ROWS:
                            known.clear()
                        known[piece] = len(library.model.tokenize(piece))
                    total += known[piece]
            counts.append(total)
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_bytes"), pa.array(counts, pa.int64())], names=["_key", "_bytes", "_count"])


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts equal the library's ids for the whole text without added tokens; a special string in
    the text is one token, its default. Null and empty texts have no bytes and no tokens.
    Repeated rows stay, each with its count. An empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{key}`").alias("_key"), whole(text).alias("_text"))
    unknown = F.col("_text").rlike(UNKNOWN)
    plain = _count_plain(slim.where(~unknown), tokenizer)
    kind = slim.schema["_key"].dataType.simpleString()
    sized = slim.where(unknown).select("_key", "_text", F.octet_length("_text").cast("long").alias("_bytes"))
    other = sized.mapInArrow(lambda batches: _count_texts(batches, tokenizer), f"_key {kind}, _bytes long, _count long")
    return plain.unionByName(other).select(F.col("_key").alias(key), F.col("_bytes").alias("n_bytes"), F.col("_count").alias("n_tokens"), (F.col("_count") > limit).alias("over_limit"))


def _count_plain(slim: DataFrame, tokenizer: str) -> DataFrame:
    """_key, _bytes and _count of the texts that the JVM's pattern splits as the library does."""
    specials = special_strings(tokenizer)
    known = materialize(vocabulary(slim, tokenizer, "_text").withColumn("pre_token", _named(F.col("pre_token"))))
    levels = {r["level"]: r["rows"] for r in known.groupBy(F.floor(F.log2("uses")).alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    floor, held = max(levels, default=0) + 1, 0
    while floor > 0 and held + levels.get(floor - 1, 0) <= BROADCAST_ROWS:
        floor -= 1
        held += levels.get(floor, 0)
    frequent = F.floor(F.log2("uses")) >= floor
    hot, cold = known.where(frequent), known.where(~frequent)

    cut = F.size(F.split(F.col("_text"), "|".join(map(_quoted, specials)))) - 1 if specials else F.lit(0)
    # All of a text is read before its pre-tokens become rows, not again for each row.
    read = slim.select("_key", F.xxhash64("_text").alias("_mark"), pre_tokens(F.col("_text"), specials).alias("_all"))
    about = read.select("_key", "_mark", F.explode_outer("_all").alias("pre_token")).withColumn("pre_token", _named(F.col("pre_token")))
    first = about.join(F.broadcast(hot.select("pre_token", "pieces")), "pre_token", "left")
    # What the broadcast settled is summed under a name that no pre-token has: letters and digits never mix in one.
    settled = F.col("pieces").isNotNull() | F.col("pre_token").isNull()
    name = F.when(settled, F.concat(F.lit("a"), F.pmod("_mark", F.lit(4096)).cast("string"))).otherwise(F.col("pre_token"))
    mine = ["_key", "_mark"]
    summed = first.groupBy(*mine, name.alias("pre_token")).agg(F.sum(F.coalesce("pieces", F.lit(0))).alias("_sure"), F.count(F.lit(1)).alias("_uses"))
    second = summed.join(cold.select("pre_token", "pieces"), "pre_token", "left")
    total = second.groupBy(*mine).agg(F.sum(F.col("_sure") + F.col("_uses") * F.coalesce("pieces", F.lit(0))).alias("_sum"))
    told = slim.select("_key", F.octet_length("_text").cast("long").alias("_bytes"), F.xxhash64("_text").alias("_mark"), cut.cast("long").alias("_cut"))
    copies = told.groupBy("_key", "_mark").agg(F.count(F.lit(1)).alias("_copies"), F.first("_bytes").alias("_bytes"), F.first("_cut").alias("_cut"))
    joined = total.alias("t").join(copies.alias("c"), F.expr("t._key <=> c._key AND t._mark = c._mark"))
    tokens = (F.col("_sum") / F.col("_copies")).cast("long") + F.col("_cut")
    return joined.select("t._key", "_bytes", tokens.alias("_count"), F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")
