"""Usage metrics on the events table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from embedmap.operators import metrics
from embedmap.plans.data import table
from embedmap.plans.registry import query

NOW = datetime(2024, 1, 25, 13, 40)


def usage(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("metric"), F.col("user_id").alias("resource"), F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id"), F.floor(F.col("value") * 100).alias("value"))


@query("cost_summary", """
SELECT coalesce(event_type, 'total') AS app, CAST(sum(CAST(CAST(value AS VARCHAR) AS DECIMAL(38, 18))) AS DOUBLE) AS cost
FROM events GROUP BY ROLLUP (event_type)""")
def cost_summary(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("app"), F.col("value").cast("string").alias("cost"))
    return metrics.cost_summary(rows).select(F.coalesce("app", F.lit("total")).alias("app"), F.col("cost").cast("double").alias("cost"))


SECONDS = "CAST(epoch_us({}) // 1000000 AS BIGINT)"


def _times(df):
    return df.select(F.col("value").cast("long").alias("value"), *[F.floor(F.unix_micros(c) / 1000000).alias(c) for c in ("observed_at", "oldest_at")])


@query("summarize_delta", f"""
SELECT CAST(sum(floor(value * 100)) AS BIGINT) AS value, {SECONDS.format('max(ts)')} AS observed_at, {SECONDS.format('min(ts)')} AS oldest_at FROM events""")
def summarize_delta(spark, sf):
    return _times(metrics.summarize_metrics(usage(spark, sf), gauge=False))


@query("summarize_gauge", f"""
SELECT CAST(sum(v) AS BIGINT) AS value, {SECONDS.format('max(ts)')} AS observed_at, {SECONDS.format('min(ts)')} AS oldest_at FROM (
  SELECT floor(value * 100) AS v, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, value) AS k FROM events) WHERE k = 1""")
def summarize_gauge(spark, sf):
    """Every page is delivered twice; a gauge must not notice."""
    once = usage(spark, sf)
    return _times(metrics.summarize_metrics(once.unionByName(once), gauge=True))


@query("hourly_usage", """
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type AS metric, CAST(sum(floor(value * 100)) AS BIGINT) AS value, count(*) AS n
FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-25 13:00:00' GROUP BY 1, 2""")
def hourly_usage(spark, sf):
    out = metrics.hourly_usage(usage(spark, sf), ["metric"], NOW)
    return out.withColumn("hour", F.unix_timestamp("hour"))


@query("carry_forward", """
WITH s AS (SELECT event_type AS provider, event_id AS seq, CASE WHEN user_id % 3 <> 0 THEN value END AS v, CASE WHEN user_id % 3 <> 0 THEN event_id END AS g FROM events)
SELECT provider, seq, v IS NOT NULL AS ok, coalesce(last_value(v IGNORE NULLS) OVER w, -1) AS value, coalesce(last_value(g IGNORE NULLS) OVER w, -1) AS last_success
FROM s WINDOW w AS (PARTITION BY provider ORDER BY seq)""")
def carry_forward(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("provider"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"),
        F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("value"))
    return metrics.carry_forward(ev).select(
        "provider", "seq", "ok", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("last_success_at", F.lit(-1)).alias("last_success"))


@query("retain", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-18 13:40:00'")
def retain(spark, sf):
    return metrics.retain(usage(spark, sf), NOW, 7).select("event_id")


@query("progress_status", """
SELECT job, CASE WHEN state IS NULL THEN 'not started' WHEN NOT valid THEN 'status unavailable' ELSE state END AS status, age_seconds,
  CASE WHEN state IS NULL THEN false WHEN NOT valid THEN true ELSE age_seconds > 120 AND state NOT IN ('complete', 'failed', 'not started') END AS stale
FROM (SELECT event_id AS job, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'running' END AS state,
  user_id % 2 = 0 AS valid, CAST(greatest(0, epoch(TIMESTAMP '2024-01-25 13:40:00')::BIGINT - epoch_us(ts) // 1000000) AS BIGINT) AS age_seconds FROM events)""")
def progress_status(spark, sf):
    t = F.col("event_type")
    state = F.when(t == "view", None).when(t == "click", "complete").when(t == "error", "failed").otherwise("running")
    df = table(spark, sf, "events").select(
        F.col("event_id").alias("job"), state.alias("state"), F.col("ts").cast("timestamp").alias("updated_at"), (F.col("user_id") % 2 == 0).alias("valid"))
    return metrics.progress_status(df, NOW)


@query("release_gate", """
SELECT count(*) AS n_shards, CAST(sum(n) AS BIGINT) AS n_rows, false AS stopped, true AS complete, true AS ready FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def release_gate(spark, sf):
    o = table(spark, sf, "orders")
    receipts = o.groupBy(F.col("o_custkey").alias("shard")).agg(F.count(F.lit(1)).alias("rows")).withColumn("state", F.lit("complete"))
    return metrics.release_gate(receipts, o.count(), o.select("o_custkey").distinct().count())


@query("operation_counts", "SELECT event_type AS action, user_id % 4 AS status, CAST(sum(length(props)) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def operation_counts(spark, sf):
    ops = table(spark, sf, "events").select(F.col("event_type").alias("action"), (F.col("user_id") % 4).alias("status"), F.length("props").cast("long").alias("n"))
    return metrics.operation_counts(ops)
