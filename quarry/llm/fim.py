"""Fill-in-middle: a text cut at two token borders is rearranged so that its middle comes last.

Tokens are words with the white space before them, and white space at the end; so a token ends
wherever a character that is no white space stands before white space, and at the end of the text.
A text is cut into chunks that overlap by one character, so each such pair of characters lies in
one chunk whole; borders are counted chunk by chunk, running sums tell the chunk that owns each
cut's rank, and these chunks alone are scanned again for the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

MARKS = ("<P>", "<S>", "<M>")
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80

#: Between a character that is no white space and white space after it.
BORDER = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"

#: Code points of a chunk at least, and chunks of a text at most (longer texts have longer chunks).
CHUNK, CHUNKS = 4096, 256


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of the seed and the decimal key (null: the word null)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def border_counts(text: Column, n_chars: Column, step: Column) -> Column:
    """Borders within each chunk, by chunk; a chunk has ``step`` code points and the next chunk's first."""
    starts = F.when(n_chars > 0, F.sequence(F.lit(1), n_chars, step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.size(F.split(F.substring(text, s, step + 1), BORDER)) - 1)


def running(counts: Column) -> Column:
    """Sums of what lies before each chunk, and of all at the end."""
    return F.aggregate(counts, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))


def place(text: Column, rank: Column, before: Column, n_chars: Column, step: Column) -> Column:
    """Code points before the border of this rank: 0 for none, all for a rank beyond the last border."""
    owner = F.size(F.filter(before, lambda n: n < rank)) - 1
    pieces = F.split(F.substring(text, owner * step + 1, step + 1), BORDER)
    within = F.aggregate(F.slice(pieces, 1, rank - F.element_at(before, owner + 1)), F.lit(0), lambda sums, piece: sums + F.length(piece))
    return F.when(rank <= 0, 0).when(rank > F.element_at(before, -1), n_chars).otherwise(owner * step + within).cast("bigint")


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with n (tokens), form, prefix_chars, middle_chars and output (columns of these names are replaced).

    form is plain (output is the text, the two numbers null), psm (prefix, suffix, middle, each
    after its mark) or spm (suffix first). Rows are independent and stay where they are: no shuffle.
    Null and empty texts are empty, plain, of no token; a text with a mark in it is plain; equal
    keys draw alike, so repeated rows come out equal; rows of null key draw by the word null. A
    text is one row and one task's work; the longest has ``CHUNKS`` chunks.
    """
    made = docs.drop("n", "form", "prefix_chars", "middle_chars", "output", "_text", "_len", "_step", "_before", "_h", "_a", "_b")
    made = made.withColumn("_text", whole(text)).withColumn("_len", F.length("_text"))
    made = made.withColumn("_step", F.greatest(F.lit(chunk), F.ceil(F.col("_len") / CHUNKS).cast("int")))
    made = made.withColumn("_before", running(border_counts(F.col("_text"), F.col("_len"), F.col("_step"))))
    last_ends = F.col("_len") > 0
    made = made.withColumn("n", (F.element_at("_before", -1) + last_ends.cast("int")).cast("bigint")).withColumn("_h", F.array(*draws(F.col(f"`{key}`"), seed)))
    h = lambda k: F.col("_h")[k]
    marked = F.contains("_text", F.lit(MARKS[0])) | F.contains("_text", F.lit(MARKS[1])) | F.contains("_text", F.lit(MARKS[2]))
    form = F.when(~last_ends | (h(2) % 100 >= fim_percent), "plain").when(marked, "plain").when(h(3) % 100 < spm_percent, "spm").otherwise("psm")
    made = made.withColumn("form", form)
    cuts = [h(k) % (F.col("n") + 1) for k in range(2)]
    at = lambda rank: F.when(F.col("form") != "plain", place(F.col("_text"), rank.cast("int"), F.col("_before"), F.col("_len"), F.col("_step")))
    made = made.withColumn("prefix_chars", at(F.least(*cuts))).withColumn("_b", at(F.greatest(*cuts))).withColumn("middle_chars", F.col("_b") - F.col("prefix_chars"))
    piece = lambda start, size: F.substring("_text", (start + 1).cast("int"), size.cast("int"))
    prefix, middle, suffix = piece(F.lit(0), F.col("prefix_chars")), piece(F.col("prefix_chars"), F.col("middle_chars")), piece(F.col("_b"), F.col("_len"))
    p, s, m = map(F.lit, MARKS)
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return made.withColumn("output", output).drop("_text", "_len", "_step", "_before", "_h", "_b")


def restore(output: Column, form: Column) -> Column:
    """The text again, from output and form alone; marks stand in an output once each, as no piece holds one."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def digest(transformed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row: key, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the restored text."""
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed.select(key, "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
