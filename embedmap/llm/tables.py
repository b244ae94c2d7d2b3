"""Intermediate tables in the shared folder, and joins whose broadcast side has a checked size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.session import ensure_checkpoint_dir

#: Rows of a table that may be broadcast (narrow rows: keys and a few numbers).
BROADCAST_ROWS = 100_000


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back: cuts lineage, survives lost executors.

    Hadoop deletes the folder when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is (Spark then joins by shuffle)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def carried(docs: DataFrame, into: str, **values: Column) -> DataFrame:
    """``docs`` as one struct column ``row``, beside the helper columns ``values``: no helper can meet a column of the input.

    ``into`` is the column that the operator will add; a column of that name in the input gives way to it.
    """
    columns = [docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), *[v.alias(n) for n, v in values.items()])


def released(df: DataFrame, columns: list[str], into: str, made: Column) -> DataFrame:
    """The columns of a carried input again, and ``made`` as ``into``."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c != into], made.alias(into))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores after it until the input has no such column."""
    while name in docs.columns:
        name += "_"
    return name
