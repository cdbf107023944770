"""Measurements: batch statistics, component metrics, caches, health, file priorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators import registers
from quarry.sources.registry import Registry

from .base import query


def _events(spark, d):
    return Registry(spark, d).table("events")


@query("batch_stats", "SELECT count(*) AS files, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS functions, round(avg(value), 4) AS mean_time FROM events")
def batch_stats(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return _events(spark, d).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("event_type") != "error").alias("succeeded"), F.count_if(F.col("event_type") == "error").alias("failed"), F.sum(k).alias("functions"), F.round(F.avg("value"), 4).alias("mean_time"))


_HOST = "regexp_extract(url, '^[^:]+://([^/?#]+)', 1)"


@query("group_by_parent", "SELECT coalesce(nullif(regexp_extract(path, '([^/]+)/[^/]*$', 1), ''), 'Common') AS parent, count(*) AS files, min(path) AS first_file FROM (SELECT regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1) AS path FROM pages) GROUP BY 1")
def group_by_parent(spark, d):
    path = F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)", 1)
    p = Registry(spark, d).table("pages").select(path.alias("path"))
    return p.groupBy(M.parent_folder(F.col("path")).alias("parent")).agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_file"))


_METRICS = "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type"


@query("metrics_agg", _METRICS)
def metrics_agg(spark, d):
    return M.component_metrics(_events(spark, d), "event_type", "value")


_LAST = "SELECT event_type, CAST(rn AS INTEGER) AS place, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10"


@query("metrics_last", _LAST)
def metrics_last(spark, d):
    return M.last_values(_events(spark, d), "event_type", "value", ["ts", "event_id"])


@query("percentile_floor", f"SELECT event_type, (list(value ORDER BY value))[CAST(floor((count(*) - 1) * 95 / 100) AS INTEGER) + 1] AS p95 FROM ({_LAST}) GROUP BY event_type")
def percentile_floor(spark, d):
    return M.percentile_floor(metrics_last(spark, d), "event_type", "value", 95)


@query("snapshot_stats", "SELECT arg_max(value, event_id) AS current, max(value) AS peak, round(avg(value), 4) AS mean, count(*) AS snapshots FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 100)")
def snapshot_stats(spark, d):
    return M.snapshot_stats(_events(spark, d), "event_id", "value")


@query("interning_stats", "SELECT count(*) AS unique_strings, CAST(sum(n) AS BIGINT) AS requests, CAST(sum((n - 1) * strlen(p_name)) AS BIGINT) AS saved_bytes, round(1 - count(*) / sum(n), 6) AS hit_rate FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)")
def interning_stats(spark, d):
    return M.interning(Registry(spark, d).table("part"), "p_name")


@query("hit_rate", "SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) AS requests, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_rate FROM events")
def hit_rate(spark, d):
    return M.hit_rate(_events(spark, d), F.col("event_type") == "view")


_STATE = "CASE WHEN avg(value) > 12 THEN 'degraded' WHEN count(*) > 0 THEN 'healthy' ELSE 'down' END"


@query("health_score", f"SELECT round(score, 6) AS score, CASE WHEN round(score, 6) > 0.8 THEN 'healthy' WHEN round(score, 6) > 0.5 THEN 'degraded' ELSE 'unhealthy' END AS verdict FROM (SELECT avg(CASE state WHEN 'healthy' THEN 1.0 WHEN 'degraded' THEN 0.5 ELSE 0.0 END) AS score FROM (SELECT user_id, {_STATE} AS state FROM events GROUP BY user_id))")
def health_score(spark, d):
    state = F.when(F.avg("value") > 12, "degraded").when(F.count(F.lit(1)) > 0, "healthy").otherwise("down")
    return M.health(_events(spark, d).groupBy("user_id").agg(state.alias("state")), "state")


@query("usage_stats", "SELECT count(*) FILTER (event_type IN ('view', 'click')) AS web, count(*) FILTER (event_type = 'signup') AS editor, count(*) FILTER (event_type IN ('view', 'click', 'signup')) AS requests, round(count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type IN ('view', 'click', 'signup')), 0), 6) AS hit_ratio FROM events")
def usage_stats(spark, d):
    web, editor = F.count_if(F.col("event_type").isin("view", "click")), F.count_if(F.col("event_type") == "signup")
    return _events(spark, d).agg(web.alias("web"), editor.alias("editor"), (web + editor).alias("requests"), F.round(F.try_divide(F.count_if(F.col("event_type") == "view"), web + editor), 6).alias("hit_ratio"))


@query("topk_metrics", f"SELECT event_type, calls, mean FROM ({_METRICS}) ORDER BY mean DESC, event_type LIMIT 5")
def topk_metrics(spark, d):
    return metrics_agg(spark, d).select("event_type", "calls", "mean").orderBy(F.desc("mean"), "event_type").limit(5)


@query("opt_suggest", "SELECT component, issue FROM (SELECT event_type AS component, unnest(list_filter([CASE WHEN mean > 100 THEN 'slow' END, CASE WHEN calls > 1000 AND mean > 10 THEN 'often called' END, CASE WHEN calls > 100 AND mean > 20 THEN 'worth a cache' END], lambda x: x IS NOT NULL)) AS issue FROM (" + _METRICS + ")) UNION ALL SELECT 'all', 'slow' FROM (SELECT sum(value) / count(*) AS m FROM events) WHERE m > 50")
def opt_suggest(spark, d):
    return M.advice(metrics_agg(spark, d), "event_type")


_FILES = "(SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/CommonModules/m' WHEN 1 THEN '/Catalogs/c' WHEN 2 THEN '/Documents/d' WHEN 3 THEN '/Reports/r' ELSE '/Other/o' END || page_id AS path FROM pages)"


@query("priority_sort", f"SELECT path, CASE WHEN contains(lower(path), 'commonmodules') THEN 1 WHEN contains(lower(path), 'catalogs') OR contains(lower(path), 'documents') THEN 2 WHEN contains(lower(path), 'reports') OR contains(lower(path), 'dataprocessors') THEN 3 ELSE 4 END AS priority FROM {_FILES} ORDER BY priority, path")
def priority_sort(spark, d):
    k = F.col("page_id") % 5
    head = F.when(k == 0, "/CommonModules/m").when(k == 1, "/Catalogs/c").when(k == 2, "/Documents/d").when(k == 3, "/Reports/r").otherwise("/Other/o")
    files = Registry(spark, d).table("pages").select(F.concat(head, F.col("page_id").cast("string")).alias("path"))
    return files.select("path", M.path_priority(F.col("path")).alias("priority")).orderBy("priority", "path")


@query("cache_ttl_filter", "SELECT event_id, ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY AS valid FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY")
def cache_ttl_filter(spark, d):
    """Entries younger than the purge age, and whether they are still valid."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return _events(spark, d).where(F.col("ts") > now - F.expr("INTERVAL 20 DAY")).select("event_id", (F.col("ts") > now - F.expr("INTERVAL 10 DAY")).alias("valid"))


@query("incremental_anti_join", "SELECT doc_id, sha256(text) AS mark FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def incremental_anti_join(spark, d):
    """What a cache keyed by content does not hold yet."""
    docs = Registry(spark, d).table("documents").select("doc_id", F.sha2("text", 256).alias("mark"))
    return docs.join(docs.where("doc_id % 2 = 0").select("mark").distinct(), "mark", "left_anti").select("doc_id", "mark")


@query("latest_per_key", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 2")
def latest_per_key(spark, d):
    return registers.ranked(_events(spark, d), ["user_id"], [F.desc("value"), F.col("event_id")], 2).select("user_id", "event_id")
