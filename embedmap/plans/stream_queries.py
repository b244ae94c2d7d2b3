"""Streams over files written from the provided tables, compared with their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from embedmap.plans.data import table
from embedmap.plans.registry import query
from embedmap.session import ensure_checkpoint_dir
from embedmap.streaming import ingest


def _root(spark):
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("ingest_shards", """
SELECT o_orderpriority AS shard, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, CAST(sum(o_custkey) AS BIGINT) AS keys_sum FROM orders GROUP BY 1""")
def ingest_shards(spark, sf):
    """Orders that arrive in two drops, ingested after each; the second run skips what the first has stored, and the receipts are folded in between."""
    root, orders = _root(spark), table(spark, sf, "orders").withColumn("shard", F.col("o_orderpriority"))
    for drop in range(2):
        orders.filter(F.col("o_orderkey") % 2 == drop).write.mode("append").parquet(f"{root}/in")
        ingest.ingest_shards_stream(spark, f"{root}/in", f"{root}/out", f"{root}/log", orders.schema).awaitTermination()
        if drop == 0:
            ingest.fold_receipts(spark, f"{root}/out")
    return ingest.read_ingested(spark, f"{root}/out").groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"), F.sum("o_custkey").alias("keys_sum"))


@query("ingest_receipts", """
SELECT o_orderpriority AS shard, count(*) AS n_rows FROM orders GROUP BY 1""")
def ingest_receipts(spark, sf):
    """Rows by shard according to the folded receipts and those written since."""
    root, orders = _root(spark), table(spark, sf, "orders").withColumn("shard", F.col("o_orderpriority"))
    for drop in range(3):
        orders.filter(F.col("o_orderkey") % 3 == drop).write.mode("append").parquet(f"{root}/in")
        ingest.ingest_shards_stream(spark, f"{root}/in", f"{root}/out", f"{root}/log", orders.schema).awaitTermination()
        if drop < 2:
            ingest.fold_receipts(spark, f"{root}/out")
    return ingest.receipts(spark, f"{root}/out").groupBy("shard").agg(F.sum("n_rows").alias("n_rows"))


@query("hourly_usage_stream", """
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type AS metric, round(sum(value), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2""")
def hourly_usage_stream(spark, sf):
    """Hourly sums of a stream of event files, one file a batch, with a watermark that no row is behind; the batch form is the check."""
    root = _root(spark)
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("metric"), "value")
    events.repartitionByRange(4, "at").write.parquet(f"{root}/in")
    hours = ingest.stored_usage_stream(spark, f"{root}/in", f"{root}/out", f"{root}/log", events.schema, ["metric"], "400 days")
    return hours.select(F.unix_timestamp("hour").alias("hour"), "metric", F.round("value", 6).alias("value"), "n")
