"""Pages of a kept order: ranges with their numbers of rows, of which a page reads the one or two that hold it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.versioned import Versioned


class Ordered:
    """Rows of ``schema`` in the order of ``by`` (ascending; rows that are equal in it have no order of their own)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, by: list[str], ranges: int = 64):
        self.table, self.by, self.ranges = Versioned(spark, folder), by, ranges
        self.schema = spark.createDataFrame([], schema).schema

    def build(self, rows: DataFrame) -> int:
        """Range the rows anew; the new version."""
        base = self.table.version()
        dealt = rows.select(*self.schema.names).repartitionByRange(self.ranges, *self.by).sortWithinPartitions(*self.by)
        path = self.table.write(dealt.withColumn("_p", F.spark_partition_id()), "_p")
        held = sorted(int(n.removeprefix("_p=")) for n in self.table.names(path) if n.startswith("_p="))
        parts = []
        if held:
            counted = self.table.spark.read.parquet(f"{self.table.folder}/{path}").groupBy("_p").count().collect()
            numbers = {r["_p"]: r["count"] for r in counted}
            parts = [{"path": f"{path}/_p={p}", "rows": numbers[p]} for p in held]
        return self.table.commit({"parts": parts}, base)

    def page(self, number: int, size: int, first: int = 0) -> DataFrame:
        """Rows of one page with _total, _pages, _has_next and _has_previous, as ``search.page`` gives them; pages count from ``first``."""
        if number < first or size < 1:
            raise ValueError("no such page")
        parts = self.table.manifest().get("parts", [])
        ends = list(accumulate(p["rows"] for p in parts))
        total, k = ends[-1] if ends else 0, number - first
        low, high = k * size, (k + 1) * size
        held = [(p, end) for p, end in zip(parts, ends, strict=True) if end > low and end - p["rows"] < high]
        before = held[0][1] - held[0][0]["rows"] if held else 0
        rows = self.table.read(self.schema, [p["path"] for p, _ in held]).orderBy(*self.by).offset(max(0, low - before)).limit(size)
        pages = -(-total // size)
        about = {"_total": total, "_pages": pages}
        return rows.select("*", *[F.lit(v).cast("long").alias(n) for n, v in about.items()], F.lit(k + 1 < pages).alias("_has_next"), F.lit(k > 0).alias("_has_previous"))
