"""Usage metrics, latency summaries and gates over receipts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embedmap.operators.ordering import HOT_ROWS, exact_percentiles, with_bucket

TERMINAL = ("complete", "failed", "not started")  # fixed values: states that cannot become stale
STALE_SECONDS = 120
STALLED_SECONDS = 1800  # fixed: an unfinished input without progress for this long is a failure
RETENTION_DAYS = 31


def latency_summary(df: DataFrame, by: str) -> DataFrame:
    """p50, p95, first and slowest of ``ms`` per configuration. ``df``: by, seq, ms."""
    ranks = exact_percentiles(df, [by], ["ms"], [0.5, 0.95])
    wide = ranks.groupBy(by).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95")
    )
    rest = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min_by("ms", "seq").alias("first_ms"), F.max("ms").alias("max_ms"))
    return rest.join(wide, by)


def cost_summary(df: DataFrame) -> DataFrame:
    """Exact decimal cost per application and in total (app is null in the total row). ``df``: app, cost as text."""
    return df.rollup("app").agg(F.sum(F.col("cost").cast("decimal(38,18)")).cast("decimal(38,18)").alias("cost"))


def summarize_metrics(points: DataFrame, gauge: bool) -> DataFrame:
    """Sum of all points (delta) or of the latest point per series (gauge), with newest and oldest time used.

    ``points``: metric, resource, at, value. A page delivered twice does not count twice in a gauge.
    """
    used = points
    if gauge:
        # The first delivered of equal times wins; with unordered rows the smallest value is the deterministic stand-in.
        latest = F.max(F.struct("at", (-F.col("value")).alias("_neg")))
        used = points.groupBy("metric", "resource").agg(latest.alias("_l")).select(F.col("_l.at").alias("at"), (-F.col("_l._neg")).alias("value"))
    return used.agg(F.sum("value").alias("value"), F.max("at").alias("observed_at"), F.min("at").alias("oldest_at"))


def month_window(now: datetime) -> tuple[datetime, datetime]:
    """Month to date through the last complete hour."""
    return now.replace(day=1, hour=0, minute=0, second=0, microsecond=0), now.replace(minute=0, second=0, microsecond=0)


def in_window(at: str, now: datetime) -> Column:
    start, end = month_window(now)
    return (F.col(at) >= F.lit(start).cast("timestamp")) & (F.col(at) < F.lit(end).cast("timestamp"))


def hourly_usage(events: DataFrame, by: Sequence[str], now: datetime | None = None) -> DataFrame:
    """Sums per hour and series. ``events``: at (timestamp), value. Works on a stream when a watermark is set."""
    kept = events if now is None else events.filter(in_window("at", now))
    return (
        kept.groupBy(F.window("at", "1 hour").alias("_w"), *by)
        .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("hour"), *by, "value", "n")
    )


def carry_forward(snapshots: DataFrame, bits: int = 20, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Last good value and its time at every poll. ``snapshots``: provider, seq (integer poll number), at, value or null.

    A provider with very many polls is cut into ranges of seq; the last good poll of every range is handed on.
    """
    good = F.when(F.col("value").isNotNull(), F.struct("seq", "at", "value"))
    tagged = with_bucket(snapshots, ["provider"], F.shiftright("seq", bits), hot_rows)
    w = Window.partitionBy("provider", "_bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = tagged.filter(F.col("_bucket") >= 0).groupBy("provider", "_bucket").agg(F.max(good).alias("_end"))
    before = Window.partitionBy("provider").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("provider", "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = tagged.withColumn("_local", F.last(good, ignorenulls=True).over(w)).join(carried, ["provider", "_bucket"], "left")
    best = F.coalesce("_local", "_carried")
    return out.select("provider", "seq", "at", F.col("value").isNotNull().alias("ok"), best["value"].alias("value"), best["at"].alias("last_success_at"))


def retain(snapshots: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    return snapshots.filter(F.col("at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def progress_status(receipts: DataFrame, now: datetime) -> DataFrame:
    """State and staleness of progress receipts. ``receipts``: job, state (null: no receipt), updated_at, valid."""
    age = F.greatest(F.lit(0), F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated_at")).cast("long")
    out = receipts.withColumn("age_seconds", age)
    stale = (F.col("age_seconds") > STALE_SECONDS) & ~F.col("state").isin(*TERMINAL)
    status = F.when(F.col("state").isNull(), "not started").when(~F.col("valid"), "status unavailable").otherwise(F.col("state"))
    return out.select("job", status.alias("status"), "age_seconds", F.when(F.col("state").isNull(), F.lit(False)).when(F.col("valid"), F.coalesce(stale, F.lit(False))).otherwise(F.lit(True)).alias("stale"))


def release_gate(receipts: DataFrame, expected_rows: int, expected_shards: int) -> DataFrame:
    """One row: may the release be published. A failed, partial or stalled input stops it, incomplete totals hold it back.

    ``receipts``: state, rows and optionally age_seconds; one row per shard.
    """
    bad = F.col("state").isin("failed", "partial")
    if "age_seconds" in receipts.columns:
        bad = bad | ((F.col("state") != "complete") & (F.col("age_seconds") > STALLED_SECONDS))
    return receipts.agg(
        F.count(F.lit(1)).alias("n_shards"), F.sum("rows").alias("n_rows"),
        F.coalesce(F.bool_or(bad), F.lit(False)).alias("stopped"),
        F.coalesce(F.bool_and(F.col("state") == "complete"), F.lit(False)).alias("complete"),
    ).withColumn(
        "ready", ~F.col("stopped") & F.col("complete") & (F.col("n_shards") == expected_shards) & (F.col("n_rows") == expected_rows)
    )


def operation_counts(ops: DataFrame) -> DataFrame:
    """Operations by action and status. ``ops``: action, status, n."""
    return ops.groupBy("action", "status").agg(F.sum("n").alias("n"))
