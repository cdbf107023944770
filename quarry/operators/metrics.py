"""Roll-ups of measurements: components, percentiles, caches, health, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the advice on components, in milliseconds and calls.
SLOW_MS, OFTEN, OFTEN_MS, ALL_MS, CACHE_CALLS, CACHE_MS = 100, 1000, 10, 50, 100, 20


def component_metrics(calls: DataFrame, component: str, value: str) -> DataFrame:
    """Calls, total, mean, least and most by component."""
    return calls.groupBy(component).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def last_values(calls: DataFrame, component: str, value: str, order: list[str], n: int = 10) -> DataFrame:
    """The last ``n`` values of each component, latest first, as rows (component, place, value)."""
    rank = F.row_number().over(Window.partitionBy(component).orderBy(*[F.desc(c) for c in order]))
    return calls.withColumn("place", rank).where(F.col("place") <= n).select(component, "place", value)


def percentile_floor(values: DataFrame, component: str, value: str, percent: int) -> DataFrame:
    """The value at index (n - 1) * percent / 100, rounded down, of the sorted values of each component.

    Equal values are counted before they meet, and a running sum over them finds the index.
    """
    counted = values.groupBy(component, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    mine = Window.partitionBy(component)
    upto = F.sum("_n").over(mine.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = counted.withColumn("_upto", upto).withColumn("_at", F.floor((F.sum("_n").over(mine) - 1) * percent / 100))
    return told.where("_upto > _at").groupBy(component).agg(F.min("_v").alias(f"p{percent}"))


def snapshot_stats(snapshots: DataFrame, order: str, value: str, n: int = 100) -> DataFrame:
    """The current, highest and mean value of the last ``n`` snapshots."""
    last = snapshots.orderBy(F.desc(order)).limit(n)
    return last.agg(F.max_by(value, order).alias("current"), F.max(value).alias("peak"), F.round(F.avg(value), 4).alias("mean"), F.count(F.lit(1)).alias("snapshots"))


def interning(values: DataFrame, value: str) -> DataFrame:
    """What keeping each distinct string once saves: unique strings, requests, bytes saved, share of hits."""
    each = values.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    saved = F.sum((F.col("n") - 1) * F.octet_length(value))
    return each.agg(F.count(F.lit(1)).alias("unique_strings"), F.sum("n").alias("requests"), saved.alias("saved_bytes"), F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("hit_rate"))


def hit_rate(requests: DataFrame, hit: Column) -> DataFrame:
    return requests.agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("requests"), F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("hit_rate"))


def health(layers: DataFrame, state: str) -> DataFrame:
    """The mean of the layers' scores (healthy 1, degraded 0.5, else 0) and its verdict."""
    score = F.avg(F.when(F.col(state) == "healthy", 1.0).when(F.col(state) == "degraded", 0.5).otherwise(0.0))
    verdict = F.when(F.col("score") > 0.8, "healthy").when(F.col("score") > 0.5, "degraded").otherwise("unhealthy")
    return layers.agg(F.round(score, 6).alias("score")).withColumn("verdict", verdict)


def advice(metrics: DataFrame, component: str) -> DataFrame:
    """Rows (component, issue): slow components, slow ones that are called often, ones worth a cache, and a slow whole."""
    rules = F.array_compact(F.array(F.when(F.col("mean") > SLOW_MS, "slow"), F.when((F.col("calls") > OFTEN) & (F.col("mean") > OFTEN_MS), "often called"), F.when((F.col("calls") > CACHE_CALLS) & (F.col("mean") > CACHE_MS), "worth a cache")))
    each = metrics.select(F.col(component).alias("component"), F.explode(rules).alias("issue"))
    whole = metrics.agg((F.sum("total") / F.sum("calls")).alias("_mean")).where(F.col("_mean") > ALL_MS).select(F.lit("all").alias("component"), F.lit("slow").alias("issue"))
    return each.union(whole)


def path_priority(path: Column) -> Column:
    """1 for common modules, 2 for catalogs and documents, 3 for reports and data processors, else 4."""
    low = F.lower(path)
    return F.when(low.contains("commonmodules"), 1).when(low.contains("catalogs") | low.contains("documents"), 2).when(low.contains("reports") | low.contains("dataprocessors"), 3).otherwise(4)


def parent_folder(path: Column, default: str = "Common") -> Column:
    """The name of the folder that holds the file."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), F.lit("")), F.lit(default))
