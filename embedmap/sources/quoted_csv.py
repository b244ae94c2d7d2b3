"""Records of quoted CSV files whose cells may hold line ends, read by as many tasks as the files have blocks.

A file is cut at line ends like any text. Whether a line begins inside a quoted cell is the parity of the quotes before it: each block of a
file counts its own, the counts of the blocks before are added from a table of one row per block, and a window inside the block does
the rest. Lines that begin outside begin a record; a record of several lines is joined again, also across blocks. A doubled quote counts
twice, so escaped quotes do not change the parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedmap.operators.ordering import dense_row_id, small
from embedmap.session import cut

#: Bits of a record's number within its file.
FILE_BITS = 36


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (its first byte), at (order inside the block) and text of every line."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return spark.read.option("lineSep", "\n").text(path).select(*place, F.col("value").alias("text"))


def join_records(lines: DataFrame) -> DataFrame:
    """file, number (from 0 in file order, with gaps for none) and text of every record; a carriage return at its end goes."""
    key, within = ["file", "block"], Window.partitionBy("file", "block").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    counted = lines.withColumn("quotes", (F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))).cast("long"))
    blocks = counted.groupBy(*key).agg(F.sum("quotes").alias("q"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*key, (F.coalesce(F.sum("q").over(upto), none) % 2).alias("open"))
    placed = counted.join(small(blocks), key).withColumn("begins", (F.col("open") + F.coalesce(F.sum("quotes").over(before), none)) % 2 == 0)
    # Records begun so far in the block; what a block begins with may belong to the last record of a block before.
    placed = cut(placed.withColumn("local", F.sum(F.col("begins").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0))))
    begun = placed.groupBy(*key).agg(F.max("local").alias("n"))
    begun = begun.select(*key, F.coalesce(F.sum("n").over(upto), none).alias("earlier"))
    numbered = placed.join(small(begun), key).withColumn("number", F.col("earlier") + F.col("local") - 1)
    ends = F.col("begins") & (F.col("quotes") % 2 == 0)
    alone = numbered.filter(ends).select("file", "number", "text")
    parts = numbered.filter(~ends).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("l"))
    spread = parts.select("file", "number", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    return alone.unionByName(spread).withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """line (increasing in order of file name and place), number within the file, and text of every record of the files at ``path``."""
    records = join_records(read_lines(spark, path))
    ranks = dense_row_id(records.select("file").distinct(), ["file"], "rank")
    return records.join(small(ranks), "file").select(F.shiftleft("rank", FILE_BITS).bitwiseOR(F.col("number")).alias("line"), "number", "text")
