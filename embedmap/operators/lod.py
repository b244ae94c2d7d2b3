"""Level-of-detail roll-ups over the voxel table: bricks, octree, filtered cells, storage accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embedmap.functions import grid
from embedmap.operators.voxels import weighted_colour

STEPS = (4, 2, 1)
# Fixed record sizes of the summary layouts: header, bytes per dense slot, bytes per sparse entry.
HEADER_BYTES, DENSE_BYTES, SPARSE_BYTES = 32, 16, 18


def _cells(df: DataFrame, vpc: int) -> DataFrame:
    lx, ly, lz = grid.axes_of(F.col("local_id"), vpc)
    return df.withColumns({"_lx": lx, "_ly": ly, "_lz": lz})


def _cell(axis: str) -> Column:
    return F.call_function("div", F.col(axis), F.col("step")) * F.col("step")


def with_cells(df: DataFrame, vpc: int, steps: Sequence[int]) -> DataFrame:
    """Each voxel once per step with the origin of its cell."""
    out = _cells(df, vpc).withColumn("step", F.explode(F.array(*[F.lit(s).cast("long") for s in steps])))
    return out.withColumns({"cell_x": _cell("_lx"), "cell_y": _cell("_ly"), "cell_z": _cell("_lz")})


CELL = ["chunk_id", "step", "cell_x", "cell_y", "cell_z"]


def bricks(records: DataFrame, vpc: int, steps: Sequence[int] = STEPS) -> DataFrame:
    """Cells of step 4, 2, 1: summed count, count-weighted colour, lowest occupied local id as representative."""
    return with_cells(records, vpc, steps).groupBy(*CELL).agg(
        *[weighted_colour(c) for c in "rgb"], F.min("local_id").alias("repr_local"), F.sum("n").alias("n")
    )


def tree_levels(chunks_per_axis: int) -> int:
    """Number of doublings until one root covers the grid."""
    return (chunks_per_axis - 1).bit_length()


def octree(summary: DataFrame, chunks_per_axis: int) -> DataFrame:
    """Occupied nodes at every level; level 0 are the chunks, the highest level is the root."""
    top = tree_levels(chunks_per_axis)
    levels = F.explode(F.array(*[F.lit(l) for l in range(top + 1)]))
    parts = summary.select("cx", "cy", "cz", "n_points", levels.alias("level"))
    keyed = parts.select(
        F.col("level").cast("long").alias("level"),
        *[F.expr(f"shiftright({c}, level)").alias(f"k{c[1]}") for c in ("cx", "cy", "cz")],
        "n_points",
    )
    return keyed.groupBy("level", "kx", "ky", "kz").agg(
        F.sum("n_points").alias("n_points"), F.count(F.lit(1)).alias("n_chunks")
    )


def octree_edges(tree: DataFrame) -> DataFrame:
    """Parent to child links with the octant number of the child (x is the most significant bit)."""
    child = tree.select(
        (F.col("level") + 1).alias("level"),
        *[F.shiftright(k, 1).alias(k) for k in ("kx", "ky", "kz")],
        (F.col("kx") % 2 * 4 + F.col("ky") % 2 * 2 + F.col("kz") % 2).alias("octant"),
        F.col("n_points").alias("child_points"),
    )
    return tree.select("level", "kx", "ky", "kz").join(child, ["level", "kx", "ky", "kz"])


def cell_max_counts(voxels: DataFrame, vpc: int, step: int) -> DataFrame:
    return with_cells(voxels, vpc, [step]).groupBy(*CELL).agg(F.max("n").alias("max_n"))


def threshold(t: object) -> int:
    """A valid threshold is a non-negative whole number; anything else means 1."""
    return t if isinstance(t, int) and not isinstance(t, bool) and t >= 0 else 1


def filter_by_count(voxels: DataFrame, t: object) -> DataFrame:
    """Voxels whose count exceeds the threshold."""
    return voxels.filter(F.col("n") > threshold(t))


def filter_cells_by_count(voxels: DataFrame, vpc: int, step: int, t: object) -> DataFrame:
    """Coarse cells with at least one voxel above the threshold: by maximum, never by sum."""
    return cell_max_counts(voxels, vpc, step).filter(F.col("max_n") > threshold(t))


def densest_chunk(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("n_points"), F.asc("chunk_id")).limit(1)


def summary_layout(summary: DataFrame, vpc: int) -> DataFrame:
    """Sparse or dense encoding per chunk, whichever is smaller, and its size in bytes."""
    slots = vpc**3
    sparse = F.col("n_occupied") * SPARSE_BYTES < F.lit(DENSE_BYTES * slots)
    size = F.when(sparse, F.col("n_occupied") * SPARSE_BYTES).otherwise(F.lit(DENSE_BYTES * slots).cast("long"))
    return summary.select("chunk_id", "n_occupied", sparse.alias("sparse"), (size + HEADER_BYTES).alias("encoded_bytes"))


def pack_report(summary: DataFrame, bytes_per_row: int = 33, tile_px: int = 32) -> DataFrame:
    """Sizes of a whole pack from its chunk summaries."""
    return summary.agg(
        F.sum("n_points").alias("n_rows"),
        F.sum("n_occupied").alias("n_voxels"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.max("max_n").alias("max_voxel"),
        (F.sum("n_points") * bytes_per_row).alias("row_bytes"),
        F.sum(F.col("side") * F.col("side") * (tile_px * tile_px * 4)).alias("rgba_bytes"),
    )


def occupancy_stratum(n_occupied: Column) -> Column:
    """Four strata: up to 16, 64, 256, and more."""
    return (
        F.when(n_occupied <= 16, 0).when(n_occupied <= 64, 1).when(n_occupied <= 256, 2).otherwise(3).cast("long")
    )


def stratified_ratio_estimate(df: DataFrame, per_stratum: int = 4) -> DataFrame:
    """Estimate sum(target) per stratum from evenly spaced samples and the known sum(base).

    ``df`` has one row per chunk: chunk_id, n_occupied, base, target. The chunk table is bounded by the grid.
    """
    df = df.withColumn("stratum", occupancy_stratum(F.col("n_occupied")))
    by = Window.partitionBy("stratum")
    ranked = df.withColumn("_i", F.row_number().over(by.orderBy("n_occupied", "chunk_id")) - 1).withColumn(
        "_m", F.count(F.lit(1)).over(by)
    )
    k = F.least(F.lit(per_stratum), F.col("_m"))
    wanted = F.transform(
        F.sequence(F.lit(0), (k - 1).cast("int")),
        lambda j: F.rint(F.when(k > 1, j * (F.col("_m") - 1) / (k - 1)).otherwise(F.lit(0.0))).cast("long"),
    )
    picked = F.array_contains(wanted, F.col("_i").cast("long"))
    return (
        ranked.withColumn("_picked", picked)
        .groupBy("stratum")
        .agg(
            F.count(F.lit(1)).alias("n_chunks"),
            F.count_if("_picked").alias("n_sampled"),
            F.sum("base").alias("base_total"),
            (F.sum(F.when(F.col("_picked"), F.col("target"))) / F.sum(F.when(F.col("_picked"), F.col("base")))).alias("ratio"),
        )
        .withColumn("estimate", F.col("base_total") * F.col("ratio"))
    )
