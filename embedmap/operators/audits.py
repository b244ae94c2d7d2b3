"""Audits of published tables: each returns the rows that contradict the contract, or a one-row report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embedmap.functions import codec
from embedmap.operators import frames, voxels
from embedmap.operators.keys import check_dense
from embedmap.operators.minimap import spatial_pages

VOXEL = ["chunk_id", "local_id"]


def audit_postings(postings: DataFrame, n: int) -> DataFrame:
    """Every row 0..n-1 exactly once."""
    return check_dense(postings, "row_id", n)


def audit_offsets(records: DataFrame, summary: DataFrame) -> DataFrame:
    """Voxels whose offset is not the exclusive prefix sum, and chunks whose counts do not add up."""
    again = voxels.voxel_offsets(records.select(*VOXEL, "n")).select(*VOXEL, F.col("point_offset").alias("_expected"))
    wrong = records.join(again, VOXEL).filter(~F.col("point_offset").eqNullSafe(F.col("_expected")))
    sums = records.groupBy("chunk_id").agg(F.sum("n").alias("_n")).join(summary.select("chunk_id", "n_points"), "chunk_id", "full")
    off = sums.filter(~F.col("_n").eqNullSafe(F.col("n_points")))
    none = F.lit(-1).cast("long")
    return wrong.select(*VOXEL, F.lit("offset").alias("problem")).unionByName(
        off.select("chunk_id", none.alias("local_id"), F.lit("chunk total").alias("problem")))


def audit_representatives(records: DataFrame, postings: DataFrame) -> DataFrame:
    """Voxels whose representative is not among their postings."""
    mine = records.select(*VOXEL, F.col("repr_row_id").alias("row_id"))
    return mine.join(postings.select(*VOXEL, "row_id"), [*VOXEL, "row_id"], "left_anti")


def posting_order_violations(postings: DataFrame) -> DataFrame:
    """Postings whose row id does not exceed the one before it; the predecessor comes from an equi join on pos."""
    nxt = postings.select(*VOXEL, (F.col("pos") + 1).alias("pos"), F.col("row_id").alias("_previous"))
    return postings.join(nxt, [*VOXEL, "pos"]).filter(F.col("row_id") <= F.col("_previous")).select(*VOXEL, "row_id", "pos")


def audit_assignment(points: DataFrame, stored: DataFrame, frame: frames.Frame, n: int, vpc: int) -> DataFrame:
    """Rows whose stored voxel differs from the one recomputed from their coordinates."""
    again = frames.assign_points(points, frame, n, vpc).select("row_id", F.col("chunk_id").alias("_c"), F.col("local_id").alias("_l"))
    joined = stored.select("row_id", *VOXEL).join(again, "row_id", "full")
    same = F.col("chunk_id").eqNullSafe(F.col("_c")) & F.col("local_id").eqNullSafe(F.col("_l"))
    return joined.filter(~same).select("row_id", *VOXEL)


def audit_xy(points: DataFrame, stored: DataFrame, frame: frames.Frame) -> DataFrame:
    """Rows whose stored quantised position differs from the one recomputed."""
    again = frames.quantize(points, frame).select("row_id", F.col("qx").alias("_x"), F.col("qy").alias("_y"))
    joined = stored.select("row_id", "qx", "qy").join(again, "row_id", "full")
    return joined.filter(~(F.col("qx").eqNullSafe(F.col("_x")) & F.col("qy").eqNullSafe(F.col("_y")))).select("row_id", "qx", "qy")


def audit_point_index(points: DataFrame, index: DataFrame) -> DataFrame:
    """Rows whose reference or subset code differs from the points table. Both: row_id, ref, code."""
    other = index.select("row_id", F.col("ref").alias("_ref"), F.col("code").alias("_code"))
    joined = points.select("row_id", "ref", "code").join(other, "row_id", "full")
    return joined.filter(~(F.col("ref").eqNullSafe(F.col("_ref")) & F.col("code").eqNullSafe(F.col("_code")))).select("row_id")


def audit_spatial(rows: DataFrame, pages: DataFrame, tiled: DataFrame, row_to_voxel: DataFrame, page_size: int) -> DataFrame:
    """Problems of the spatial table: rows missing or repeated, differing from the lookups, pages with wrong bounds.

    Repeated rows are counted on the way to the join with the lookups. A pass of its own would read row ids only, which shrink so far in a
    shuffle that a partition of the usual bytes holds ten million of them and a task sorts them all.
    """
    once = Window.partitionBy("row_id")
    nth = F.row_number().over(once.orderBy("row_id"))
    truth = tiled.select("row_id", F.col("pos").alias("_pos"), F.col("qx").alias("_x"), F.col("qy").alias("_y"), F.col("corpus").alias("_k"))
    truth = truth.join(row_to_voxel.select("row_id", F.col("chunk_id").alias("_c"), F.col("local_id").alias("_l")), "row_id").withColumn("_at", nth)
    pairs = (("pos", "_pos"), ("qx", "_x"), ("qy", "_y"), ("corpus", "_k"), ("chunk_id", "_c"), ("local_id", "_l"))
    same = F.lit(True)
    for a, b in pairs:
        same = same & F.col(a).eqNullSafe(F.col(b))
    counted = rows.select("row_id", *[a for a, _ in pairs], F.count(F.lit(1)).over(once).alias("_n"), nth.alias("_nth"))
    # Told once for each row id, however many rows and lookups have it.
    twice = (F.col("_n") > 1) & (F.col("_nth") == 1) & (F.coalesce("_at", F.lit(1)) == 1)
    found = F.array(F.when(~same, F.lit("row differs")), F.when(twice, F.lit("row repeated")))
    wrong = counted.join(truth, "row_id", "full").select(F.col("row_id").cast("long").alias("key"), F.explode(found).alias("problem"))
    again = spatial_pages(rows, page_size)
    bad_pages = voxels.table_difference(pages.select(*again.columns), again).select(F.col("page").cast("long").alias("key")).distinct()
    return wrong.filter(F.col("problem").isNotNull()).unionByName(bad_pages.select("key", F.lit("page bounds").alias("problem")))


def audit_conservation(bricks: DataFrame, tree: DataFrame, summary: DataFrame, n: int) -> DataFrame:
    """Levels that lose or invent rows: brick steps against chunk totals, octree nodes against their children, the root."""
    steps = bricks.groupBy("chunk_id", "step").agg(F.sum("n").alias("_n")).join(summary.select("chunk_id", "n_points"), "chunk_id")
    per_step = steps.filter(F.col("_n") != F.col("n_points")).select(
        F.concat(F.lit("step "), F.col("step")).alias("level"), F.col("chunk_id").alias("key"))
    up = tree.select((F.col("level") + 1).alias("level"), *[F.shiftright(k, 1).alias(k) for k in ("kx", "ky", "kz")], "n_points")
    sums = up.groupBy("level", "kx", "ky", "kz").agg(F.sum("n_points").alias("_n"))
    nodes = tree.filter(F.col("level") > 0).join(sums, ["level", "kx", "ky", "kz"], "left").filter(~F.col("n_points").eqNullSafe(F.col("_n")))
    per_node = nodes.select(F.concat(F.lit("tree "), F.col("level")).alias("level"), F.col("kx").alias("key"))
    totals = tree.groupBy("level").agg(F.sum("n_points").alias("_n")).filter(F.col("_n") != n).select(
        F.concat(F.lit("tree total "), F.col("level")).alias("level"), F.col("_n").alias("key"))
    return per_step.unionByName(per_node).unionByName(totals)


def audit_voxel_proxy(proxy: DataFrame, records: DataFrame, summary: DataFrame) -> DataFrame:
    """Proxy rows that differ from the records, and chunks whose run has not exactly the occupied count."""
    diff = voxels.table_difference(proxy, records.select(*proxy.columns)).select("chunk_id", F.concat(F.lit("row "), F.col("side")).alias("problem"))
    runs = proxy.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n")).join(summary.select("chunk_id", "n_occupied"), "chunk_id", "full")
    return diff.unionByName(runs.filter(~F.col("_n").eqNullSafe(F.col("n_occupied"))).select("chunk_id", F.lit("run length").alias("problem")))


def audit_report(postings: DataFrame, records: DataFrame, summary: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """One row of totals with the outcome of the row checks."""
    one = lambda df, **aggs: df.agg(*[v.alias(k) for k, v in aggs.items()], F.lit(0).alias("_k"))
    dense = audit_postings(postings, n).select(F.col("dense").alias("rows_once"), F.lit(0).alias("_k"))
    out = (
        one(summary, points=F.sum("n_points"), occupied_voxels=F.sum("n_occupied"), chunks=F.count(F.lit(1)), max_voxel=F.max("max_n"))
        .join(one(tree, hierarchy_nodes=F.count(F.lit(1))), "_k")
        .join(one(audit_offsets(records, summary), offset_problems=F.count(F.lit(1))), "_k")
        .join(one(audit_representatives(records, postings), stray_representatives=F.count(F.lit(1))), "_k")
        .join(dense, "_k")
    )
    return out.drop("_k")


def audit_projection_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys on which two projections disagree. Both: corpus, row_id."""
    return voxels.table_difference(a.select("corpus", "row_id"), b.select("corpus", "row_id"))
