"""Streams over changing inputs: diagnostics of module files as they arrive, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import analysis


def module_stream(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of module files, each once as it appears."""
    text = spark.readStream.option("pathGlobFilter", "*.{bsl,os}").option("recursiveFileLookup", "true").option("wholetext", "true").text(folder, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def diagnose(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the diagnostics of each batch of files to ``out`` under its number, once even if a batch runs again."""

    def batch(df: DataFrame, number: int) -> None:
        analysis.diagnostics(df).write.mode("overwrite").json(f"{out}/batch={number}")

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def windowed_counts(events: DataFrame, period: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Events and their mean value by window and kind; rows later than ``late`` are left to a batch."""
    timed = events.withColumn("_at", F.col(period).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", width), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return counted.select(F.col("window.start").alias("start"), by, "n", "mean")
