"""A cache that outlives a run: rows by key in hash buckets, of which an upsert rewrites only those it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.versioned import Versioned


class Cache:
    """Rows of ``schema`` by ``keys``; ``at`` is the time of a row's writing.

    The last write of a key wins (of equal times the one put last). Buckets are told by a hash of
    the keys, so choose as many that one fits a task. Each call that changes something is one new
    version: readers of the old one go on, and a writer that dies half-way leaves it in force.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], at: str = "at", buckets: int = 64):
        self.table, self.keys, self.at, self.buckets = Versioned(spark, folder), keys, at, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, keys: DataFrame) -> list[str]:
        """Buckets of these keys; there are ``buckets`` of them at most."""
        return [str(r[0]) for r in keys.select(self._bucket()).distinct().collect()]

    def _match(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """Null keys are keys like others."""
        named = keys.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        return rows.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]), how)

    def _paths(self, manifest: dict, only: list[str] | None = None) -> list[str]:
        return [p for b, p in manifest.items() if only is None or b in only]

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(self.schema, self._paths(self.table.manifest(version)))

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; only their buckets are read."""
        asked = keys.select(*self.keys).distinct()
        return self._match(self.table.read(self.schema, self._paths(self.table.manifest(), self._touched(asked))), asked, "left_semi")

    def _rewrite(self, base: int, manifest: dict, rows: DataFrame, touched: list[str]) -> int:
        path = self.table.write(rows.select("*", self._bucket().alias("_b")).repartition(F.col("_b")), "_b")
        there = {n.removeprefix("_b="): f"{path}/{n}" for n in self.table.names(path) if n.startswith("_b=")}
        return self.table.commit({b: p for b, p in manifest.items() if b not in touched} | there, base)

    def put(self, rows: DataFrame) -> int:
        """Upsert; the new version."""
        base = self.table.version()
        manifest = self.table.manifest(base)
        staged = self.table.write(rows.select(*self.schema.names))
        new = self.table.read(self.schema, [staged])
        touched = self._touched(new)
        old = self.table.read(self.schema, self._paths(manifest, touched))
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("_k", self._bucket())
        rest = [c for c in self.schema.names if c not in self.keys]
        last = both.groupBy("_k", *self.keys).agg(F.max_by(F.struct(*rest), F.struct(self.at, "_new", *rest)).alias("_last")).select(*self.keys, "_last.*").select(*self.schema.names)
        version = self._rewrite(base, manifest, last, touched)
        self.table.remove(staged)
        return version

    def invalidate(self, keys: DataFrame) -> int:
        """Drop the rows of these keys."""
        base = self.table.version()
        manifest = self.table.manifest(base)
        gone = keys.select(*self.keys).distinct()
        touched = [b for b in self._touched(gone) if b in manifest]
        return self._rewrite(base, manifest, self._match(self.table.read(self.schema, self._paths(manifest, touched)), gone, "left_anti"), touched)

    def clean(self, before: Column) -> int:
        """Drop the rows written before a time; only buckets that have any are rewritten."""
        base = self.table.version()
        manifest = self.table.manifest(base)
        old = self.table.read(self.schema, self._paths(manifest)).where(F.col(self.at) < before)
        touched = self._touched(old)
        return self._rewrite(base, manifest, self.table.read(self.schema, self._paths(manifest, touched)).where(~(F.col(self.at) < before) | F.col(self.at).isNull()), touched)
