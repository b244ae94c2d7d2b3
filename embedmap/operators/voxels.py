"""Voxel aggregation: representatives, postings, records, chunk summaries and proxies.

Points are aggregated once by (chunk, local) with map-side combine; everything later reads the small voxel table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embedmap.functions import grid
from embedmap.operators.frames import chunk_bbox
from embedmap.operators.keys import refusing_join
from embedmap.operators.ordering import HOT_ROWS, id_bucket, rank_in_group

NARROW_LIMIT = 65535  # largest count of the narrow record format
VOXEL = ["chunk_id", "local_id"]


def center_distance2(n: int) -> Column:
    """Squared distance of a normalised point to the centre of its voxel."""
    parts = [F.col(p) - grid.cell_center(F.col(v), n) for p, v in (("px", "vx"), ("py", "vy"), ("pz", "vz"))]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def representatives(assigned: DataFrame, n: int) -> DataFrame:
    """Per occupied voxel the row nearest to the centre (lowest row_id on ties) and the row count."""
    best = F.min(F.struct(center_distance2(n).alias("d2"), F.col("row_id")))
    return (
        assigned.groupBy(*VOXEL)
        .agg(best.alias("_best"), F.count(F.lit(1)).alias("n"))
        .select(*VOXEL, F.col("_best.row_id").alias("repr_row_id"), "n")
    )


def occupancy_overflow(voxels: DataFrame, limit: int = NARROW_LIMIT) -> DataFrame:
    """The worst voxel whose count does not fit the narrow format; empty when all fit."""
    return voxels.filter(F.col("n") > limit).orderBy(F.desc("n"), *VOXEL).limit(1)


def postings(assigned: DataFrame, hot_rows: int = HOT_ROWS, split_bits: int = 20) -> DataFrame:
    """Rows with their position inside the voxel, by ascending row_id; hot voxels are split by row_id range."""
    rows = assigned.select(*VOXEL, "row_id")
    return rank_in_group(rows, VOXEL, ["row_id"], "pos", id_bucket("row_id", split_bits), hot_rows)


def voxel_offsets(voxels: DataFrame) -> DataFrame:
    """Offset of each voxel's postings inside its chunk (at most vpc^3 rows per window partition)."""
    w = Window.partitionBy("chunk_id").orderBy("local_id").rowsBetween(Window.unboundedPreceding, -1)
    return voxels.withColumn("point_offset", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def voxel_records(voxels: DataFrame, points: DataFrame) -> DataFrame:
    """Record per voxel: count, offset, colour of the representative row, tile flag, representative."""
    colours = points.select(F.col("row_id").alias("repr_row_id"), "r", "g", "b")
    return refusing_join(voxel_offsets(voxels), colours, ["repr_row_id"], "representative without a point").select(
        *VOXEL, "n", "point_offset", "r", "g", "b", F.lit(1).cast("long").alias("has_tile"), "repr_row_id"
    )


def weighted_colour(c: str) -> Column:
    """Count-weighted mean colour, rounded half to even."""
    return F.rint(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("long").alias(c)


def chunk_summary(voxels: DataFrame, chunks_per_axis: int) -> DataFrame:
    summary = voxels.groupBy("chunk_id").agg(
        F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_occupied"), F.max("n").alias("max_n")
    )
    return chunk_bbox(summary, chunks_per_axis).withColumn("side", grid.compact_side(F.col("n_occupied")))


def chunk_colour(records: DataFrame) -> DataFrame:
    return records.groupBy("chunk_id").agg(*[weighted_colour(c) for c in "rgb"])


def side_overflow(summary: DataFrame, max_side: int) -> DataFrame:
    """Chunks whose tiles do not fit the largest allowed square."""
    return summary.filter(F.col("side") > max_side).select("chunk_id", "n_occupied", "side")


def tile_slots(voxels: DataFrame) -> DataFrame:
    """Slot (rank by local id), column and row of every occupied voxel in its chunk's square of tiles."""
    by_chunk = Window.partitionBy("chunk_id")
    slot = (F.row_number().over(by_chunk.orderBy("local_id")) - 1).cast("long")
    side = grid.compact_side(F.count(F.lit(1)).over(by_chunk))
    return (
        voxels.select(*VOXEL, slot.alias("slot"), side.alias("side"))
        .withColumn("tile_col", F.col("slot") % F.col("side"))
        .withColumn("tile_row", F.call_function("div", F.col("slot"), F.col("side")))
    )


def chunk_proxy(summary: DataFrame, colours: DataFrame, chunks_per_axis: int) -> DataFrame:
    """One row for every chunk slot of the grid, zeros where the chunk is empty."""
    slots = summary.sparkSession.range(chunks_per_axis**3).withColumnRenamed("id", "chunk_id")
    filled = summary.select("chunk_id", "n_points", "n_occupied").join(colours, "chunk_id")
    out = slots.join(filled, "chunk_id", "left").na.fill(0, ["n_points", "n_occupied", "r", "g", "b"])
    return out.withColumn("density_log2", grid.density_log2(F.col("n_points")))


def voxel_proxy(records: DataFrame, chunks_per_axis: int, vpc: int) -> DataFrame:
    """Sparse proxy of the occupied voxels; an address outside the grid is refused when the table is read."""
    fits = F.col("chunk_id").between(0, chunks_per_axis**3 - 1) & F.col("local_id").between(0, vpc**3 - 1)
    chunk = F.when(fits, F.col("chunk_id")).otherwise(F.raise_error(F.lit("voxel address outside the grid")).cast("long"))
    return records.select(chunk.alias("chunk_id"), "local_id", "n", "r", "g", "b", "repr_row_id")


def write_voxel_proxy(proxy: DataFrame, path: str) -> None:
    """Stored in canonical (chunk, local) order: range partitions, sorted inside."""
    proxy.repartitionByRange(*VOXEL).sortWithinPartitions(*VOXEL).write.mode("errorifexists").parquet(path)


def check_canonical(df: DataFrame) -> DataFrame:
    """Addresses that occur more than once; order itself is a property of the write."""
    return df.groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


FINGERPRINT_BUCKETS = 4096


def row_hash(df: DataFrame, seed: int) -> Column:
    """64-bit hash of a whole row; which columns are null is part of it."""
    cols = [df[f"`{c}`"] for c in df.columns]
    return F.xxhash64(F.lit(seed), *cols, *[c.isNull() for c in cols])


def _in_bucket(df: DataFrame) -> Column:
    return F.pmod(row_hash(df, 1), F.lit(FINGERPRINT_BUCKETS)).cast("int")


def fingerprints(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of the rows of each hash bucket: bucket, n, digest. One pass, combined before the shuffle."""
    digest = F.sum(row_hash(df, 2).cast("decimal(38,0)"))
    return df.groupBy(_in_bucket(df).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), digest.alias("digest"))


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets (at most FINGERPRINT_BUCKETS) whose rows are not the same in both tables, multiplicity included."""
    both = fingerprints(a).join(fingerprints(b).select("bucket", F.col("n").alias("_n"), F.col("digest").alias("_digest")), "bucket", "full")
    return both.filter(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_digest")))).select("bucket")


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a missing in b and the reverse, multiplicity respected. Only rows of buckets whose fingerprints differ are compared."""
    b = b.select(*a.columns)
    suspects = F.broadcast(differing_buckets(a, b))
    near = lambda df: df.join(suspects.withColumnRenamed("bucket", "_bucket"), _in_bucket(df) == F.col("_bucket"), "left_semi")
    some_a, some_b = near(a), near(b)
    return some_a.exceptAll(some_b).withColumn("side", F.lit("left")).unionByName(some_b.exceptAll(some_a).withColumn("side", F.lit("right")))


def compare_proxy(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """One row: rows of the stored proxy and of the one derived from stored records, and the rows that only one of them has."""
    diff = table_difference(stored, derived).agg(F.count_if(F.col("side") == "left").alias("n_only_stored"), F.count_if(F.col("side") == "right").alias("n_only_derived"), F.lit(0).alias("_k"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.lit(0).alias("_k"))
    return count(stored, "n_stored").join(count(derived, "n_derived"), "_k").join(diff, "_k").drop("_k")


def derive_voxel_proxy(stored_records: DataFrame, chunks_per_axis: int, vpc: int) -> DataFrame:
    """Proxy rebuilt from a stored record table; ``compare_proxy`` holds it against the stored proxy."""
    return voxel_proxy(stored_records, chunks_per_axis, vpc)


def blank_report(voxels: DataFrame, payloads: DataFrame) -> DataFrame:
    """Occupied voxels whose representative has no payload: count and share. ``payloads``: row_id, n_bytes."""
    sizes = payloads.select(F.col("row_id").alias("repr_row_id"), "n_bytes")
    blank = F.coalesce(F.col("n_bytes"), F.lit(0)) == 0
    return voxels.join(sizes, "repr_row_id", "left").agg(
        F.count(F.lit(1)).alias("n_voxels"),
        F.count_if(blank).alias("n_blank"),
        (F.count_if(blank) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("share"),
    )
