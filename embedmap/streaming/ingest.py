"""Resumable ingest of arriving shards and the streaming form of the hourly usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from embedmap.operators.metrics import hourly_usage
from embedmap.operators.ordering import small

RECEIPT = "batch long, shard string, n_rows long"


def ingest_shards_stream(spark: SparkSession, src: str, dst: str, checkpoint: str, schema: StructType | str) -> StreamingQuery:
    """Ingest every shard file of ``src`` exactly once; finished ones are skipped on restart.

    The source remembers processed files in its checkpoint. Every batch writes a folder of its own, ``batch=<id>``, and then its
    receipt; a repeated batch after a failure replaces both, and ``read_ingested`` shows batches with a receipt only. A shard may
    arrive in any number of files and batches. Files carry a ``shard`` column.
    """
    stream = spark.readStream.schema(schema).parquet(src)

    def store(batch: DataFrame, number: int) -> None:
        rows, receipt = f"{dst}/rows/batch={number}", f"{dst}/receipts/{number}"
        batch.write.mode("overwrite").parquet(rows)
        counted = batch.sparkSession.read.parquet(rows).groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count(F.lit(1)).alias("n_rows"))
        counted.select(F.lit(number).cast("long").alias("batch"), "shard", "n_rows").write.mode("overwrite").parquet(receipt)

    return (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def receipts(spark: SparkSession, dst: str) -> DataFrame:
    """Finished batches: batch, shard, n_rows, from the last snapshot of the log and the receipts written since."""
    try:
        single = spark.read.schema(RECEIPT).parquet(f"{dst}/receipts/*")
    except AnalysisException:
        single = spark.createDataFrame([], RECEIPT)
    try:
        folded = spark.read.schema(f"{RECEIPT}, upto long").parquet(f"{dst}/folded/*")
    except AnalysisException:
        return single
    last = folded.agg(F.max("upto").alias("last"))
    return folded.join(F.broadcast(last), F.col("upto") == F.col("last")).select(*single.columns).unionByName(
        single.join(F.broadcast(last), F.col("last").isNull() | (F.col("batch") > F.col("last"))).select(*single.columns))


def fold_receipts(spark: SparkSession, dst: str) -> int | None:
    """Write all receipts so far as one snapshot, so that readers open one file instead of one per batch; the batch that it reaches."""
    known = receipts(spark, dst)
    upto = known.agg(F.max("batch")).first()[0]
    if upto is not None:
        known.withColumn("upto", F.lit(upto).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{dst}/folded/{upto}")
    return upto


def read_ingested(spark: SparkSession, dst: str) -> DataFrame:
    """Rows of the finished batches. Batches are partitions, pruned by the join with the receipts; none are listed on the driver."""
    done = receipts(spark, dst).select("batch").distinct()
    if done.isEmpty():
        raise FileNotFoundError(f"no finished batch in {dst}")
    rows = spark.read.option("basePath", f"{dst}/rows").parquet(f"{dst}/rows")
    return rows.withColumn("batch", F.col("batch").cast("long")).join(small(done), "batch", "left_semi").drop("batch")


def stored_usage_stream(spark: SparkSession, src: str, dst: str, checkpoint: str, schema: StructType | str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    """Hourly sums of the stream of files in ``src``, as of its last batch: every batch stores the hours that it changed, and the latest state of an
    hour counts. Rows later than ``delay`` behind the newest are left out, as in ``hourly_usage_stream``; a restart goes on where the last run ended.
    """
    hours = hourly_usage_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), by, delay)

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{dst}/{number}")

    hours.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(f"{dst}/*")
    return states.groupBy("hour", *by).agg(F.max_by("value", "batch").alias("value"), F.max_by("n", "batch").alias("n"))


def hourly_usage_stream(events: DataFrame, by: list[str], delay: str = "10 minutes") -> DataFrame:
    """Hourly sums of a stream of (at, value): an hour is emitted once, when the watermark has passed it."""
    return hourly_usage(events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay), by)
