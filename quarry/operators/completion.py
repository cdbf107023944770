"""Completions from a kept table: each beginning with its first names, so that one bucket answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.versioned import Versioned

SCHEMA = "beginning string, names array<string>"


class Completions:
    """The first ``most`` distinct names (in lower case, by code point) of every beginning of up to ``longest`` characters.

    Only that many rows of a beginning leave a task, however many names share it. Names longer
    than ``longest`` are kept under their beginning of that length as well, for longer ones.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, most: int = 10, longest: int = 16):
        self.table, self.buckets, self.most, self.longest = Versioned(spark, folder), buckets, most, longest

    def _bucket(self, c):
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame) -> dict[str, str]:
        path = self.table.write(rows.withColumn("_b", self._bucket("beginning")).repartition("_b").sortWithinPartitions("_b", "beginning"), "_b")
        return {n.removeprefix("_b="): f"{path}/{n}" for n in self.table.names(path) if n.startswith("_b=")}

    def build(self, names: DataFrame, name: str = "name") -> int:
        """A new version from these names; null and empty ones are left out."""
        base = self.table.version()
        told = names.select(F.lower(name).alias("name")).where("name IS NOT NULL AND name <> ''").distinct()
        each = told.select("name", F.explode(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(self.longest)))).alias("n")).select("name", F.substring("name", F.lit(1), F.col("n")).alias("beginning"))
        # Spark limits each group within the tasks, before the shuffle.
        first = each.withColumn("_r", F.row_number().over(Window.partitionBy("beginning").orderBy("name"))).where(F.col("_r") <= self.most)
        table = first.groupBy("beginning").agg(F.array_sort(F.collect_list("name")).alias("names"))
        long = told.where(F.length("name") > self.longest).select(F.substring("name", 1, self.longest).alias("beginning"), F.array("name").alias("names"))
        return self.table.commit({"first": self._put(table), "long": self._put(long)}, base)

    def first(self, beginning: str) -> DataFrame:
        """suggestion: the first names with this beginning, whatever its case; none for one under two bytes. One bucket is read."""
        asked = beginning.lower()
        key = asked[: self.longest]
        kind = "long" if len(asked) > self.longest else "first"
        bucket = str(self.table.spark.range(1).select(self._bucket(F.lit(key))).first()[0])
        path = self.table.manifest().get(kind, {}).get(bucket)
        held = self.table.read(SCHEMA, [path] if path and len(asked.encode()) >= 2 else []).where(F.col("beginning") == key)
        each = held.select(F.explode("names").alias("suggestion")).where(F.col("suggestion").startswith(asked))
        return each.orderBy("suggestion").limit(self.most)
