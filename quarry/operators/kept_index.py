"""A search index that is kept: postings in blocks by term, read by bucket, with blocks skipped that can't reach the first k.

A segment has a row per block: term, level, part, most, n and the block's (doc_id, score) pairs. A
posting's score is the sum of its weights in the document; blocks hold scores of one level (a
quarter of a power of two), so a term's high scores lie apart from its low ones. Tasks make
blocks of the postings they hold and short ones are joined, so postings move in blocks, and no block grows
with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.versioned import Versioned

SCHEMA = "term string, level int, part int, most double, n long, docs array<struct<doc_id:long,score:double>>"

#: Postings that a task gathers before it makes blocks of them.
GATHERED = 1 << 19

#: The level of scores that aren't above 0.
NO_LEVEL = -(1 << 20)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks (term, level, docs) of at most ``size`` of the postings (term, doc_id, score), a stretch of ``GATHERED`` at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHERED:
            yield from _stretch(held, size)
            held, n = [], 0
    if n:
        yield from _stretch(held, size)


def _stretch(held: list[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    terms = rows.column("term").combine_chunks().dictionary_encode(null_encoding="encode")
    score = rows.column("score").combine_chunks().to_numpy(zero_copy_only=False)
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.where(score > 0, np.floor(4 * np.log2(score)), NO_LEVEL).astype(np.int64)
    code = terms.indices.to_numpy()
    order = np.lexsort((level, code))
    code, level = code[order], level[order]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (level[1:] != level[:-1])]))
    place = np.arange(len(code)) - np.repeat(first, np.diff(first, append=len(code)))
    starts = np.flatnonzero(place % size == 0)
    docs = pa.StructArray.from_arrays([rows.column("doc_id").combine_chunks().take(pa.array(order)), pa.array(score[order])], names=["doc_id", "score"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)).astype(np.int32)), docs)
    made = pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[starts])), pa.array(level[starts].astype(np.int32)), lists], names=["term", "level", "docs"])
    for at in range(0, made.num_rows, 10_000):
        yield made.slice(at, 10_000)


class Index:
    """Segments by ``buckets`` of terms below a versioned folder. A document lies in one segment."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, block: int = 1024):
        self.spark, self.table, self.buckets, self.block = spark, Versioned(spark, folder), buckets, block

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _blocks(self, made: DataFrame) -> DataFrame:
        """Rows of ``SCHEMA`` with their bucket, of blocks (term, level, docs) of any length up to ``block``: those of few postings are joined, the others stay whole.

        Each row moves once, by its bucket; whole blocks of a term go to several tasks.
        """
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = F.when(4 * F.size("docs") >= self.block, F.xxhash64(F.col("docs")[0]["doc_id"]))
        dealt = made.select("term", "level", "docs", self._bucket("term").alias("_b"), own.alias("_own")).withColumn("_s", F.pmod(F.coalesce("_own", F.lit(0)), F.lit(spread)))
        joined = dealt.repartition("_b", "_s").groupBy("_b", "_s", "term", "level", "_own").agg(F.flatten(F.collect_list("docs")).alias("docs"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("docs") - 1) / self.block)), lambda i: F.slice("docs", (i * self.block + 1).cast("int"), self.block))
        each = joined.select("_b", "term", "level", F.coalesce("_own", F.lit(0)).alias("_own"), F.posexplode(F.when(F.size("docs") <= self.block, F.array("docs")).otherwise(cut)).alias("_k", "docs"))
        part = F.pmod(F.col("_own") + F.col("_k"), F.lit((1 << 31) - 1)).cast("int")
        return each.select("_b", "term", "level", part.alias("part"), F.array_max("docs.score").alias("most"), F.size("docs").cast("long").alias("n"), "docs")

    def _write(self, made: DataFrame) -> dict:
        path = self.table.write(made.sortWithinPartitions("_b", "term", F.desc("level")), "_b")
        held = [n.removeprefix("_b=") for n in self.table.names(path) if n.startswith("_b=")]
        return {"path": path, "postings": self.table.read(SCHEMA, [f"{path}/_b={b}" for b in held]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "buckets": held}

    def segments(self) -> list[dict]:
        return self.table.manifest().get("segments", [])

    def add(self, postings: DataFrame) -> int:
        """A segment of ``postings`` (doc_id, term, weight) of documents that the index doesn't have yet."""
        base = self.table.version()
        scored = postings.groupBy("term", F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.sum("weight"), 6).alias("score"))
        size = self.block
        made = self._write(self._blocks(scored.mapInArrow(lambda batches: gathered(batches, size), "term string, level int, docs array<struct<doc_id:long,score:double>>")))
        return self.table.commit({"segments": [*self.table.manifest(base).get("segments", []), made]}, base)

    def merge(self, least: int) -> int:
        """Segments of under ``least`` postings become one: blocks move whole, and those of few postings are joined, block by block."""
        base = self.table.version()
        now = self.table.manifest(base).get("segments", [])
        small = [s for s in now if s["postings"] < least]
        if len(small) < 2:
            return base
        made = self.table.read(SCHEMA, [f"{s['path']}/_b={b}" for s in small for b in s["buckets"]])
        return self.table.commit({"segments": [s for s in now if s not in small] + [self._write(self._blocks(made))]}, base)

    def of(self, terms: list[str]) -> DataFrame:
        """Blocks of these terms: only the folders of their buckets are listed and read."""
        asked = {str(b) for b in self.spark.range(1).select(F.array(*[self._bucket(F.lit(t)) for t in terms])).first()[0]} if terms else set()
        paths = [f"{s['path']}/_b={b}" for s in self.segments() for b in s["buckets"] if b in asked]
        return self.table.read(SCHEMA, paths).where(F.col("term").isin(terms))

    def wanted(self, words: list[str], k: int) -> DataFrame:
        """The blocks that may hold one of the ``k`` best documents.

        The best levels of each term that have k documents give k scores that are reached at
        least. A block whose best score, with the best of all other words, stays below the least
        of these can be left out: no document in it is among the k. A level a term is all that
        comes here.
        """
        times: dict[str, int] = {}
        for w in words:
            times[w.lower()] = times.get(w.lower(), 0) + 1
        held = self.of(list(times))
        levels: dict[str, list] = {}
        for r in held.groupBy("term", "level").agg(F.max("most").alias("most"), F.sum("n").alias("n")).collect():
            levels.setdefault(r.term, []).append((r.level, r.most * times[r.term], r.n))
        if not levels:
            return held
        best = {t: max(m for _, m, _ in x) for t, x in levels.items()}
        first = F.lit(False)
        for t, x in levels.items():
            have, low = 0, None
            for level, _, n in sorted(x, reverse=True):
                have, low = have + n, level
                if have >= k:
                    break
            first = first | ((F.col("term") == t) & (F.col("level") >= low))
        found = score(held.where(first), times).orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count(F.lit(1))).first()
        if found[1] < k:
            return held
        reach = F.lit(False)
        for t in levels:
            others = sum(m for u, m in best.items() if u != t)
            # Sums of rounded scores: a hair below the bound is kept.
            reach = reach | ((F.col("term") == t) & (F.col("most") * times[t] + others >= found[0] - 1e-6))
        return held.where(reach)

    def search(self, words: list[str], k: int) -> DataFrame:
        """doc_id and score of the ``k`` best documents (of equal scores the least ids), best first; a repeated word counts again."""
        times: dict[str, int] = {}
        for w in words:
            times[w.lower()] = times.get(w.lower(), 0) + 1
        return score(self.wanted(words, k), times).orderBy(F.desc("score"), "doc_id").limit(k)


def score(held: DataFrame, times: dict[str, int]) -> DataFrame:
    weight = F.try_element_at(F.create_map(*[x for t, n in times.items() for x in (F.lit(t), F.lit(float(n)))]), F.col("term")) if times else F.lit(0.0)
    return held.select(weight.alias("_w"), F.explode("docs").alias("d")).groupBy("d.doc_id").agg(F.round(F.sum(F.col("d.score") * F.col("_w")), 6).alias("score"))
