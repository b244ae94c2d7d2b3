"""Voxel tables, postings, proxies and roll-ups on the order points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from embedmap.functions import grid
from embedmap.operators import lod, voxels
from embedmap.plans.data import G, VPC, assigned, records, summary, table, voxel_table
from embedmap.plans.registry import part, query
from embedmap.session import ensure_checkpoint_dir


@query("representatives", "SELECT chunk_id, local_id, repr_row_id, n FROM vox")
def representatives(spark, sf):
    return voxel_table(spark, sf)


@query("occupancy_overflow", "SELECT chunk_id, local_id, repr_row_id, n FROM vox WHERE n > 5 ORDER BY n DESC, chunk_id, local_id LIMIT 1")
def occupancy_overflow(spark, sf):
    return voxels.occupancy_overflow(voxel_table(spark, sf), 5)


@query("postings", "SELECT chunk_id, local_id, row_id, pos FROM post")
def postings(spark, sf):
    return voxels.postings(assigned(spark, sf))


@query("voxel_offsets", "SELECT chunk_id, local_id, repr_row_id, n, point_offset FROM rec")
def voxel_offsets(spark, sf):
    return voxels.voxel_offsets(voxel_table(spark, sf))


@query("voxel_records", "SELECT * FROM rec")
def voxel_records(spark, sf):
    return records(spark, sf)


BOX = ", ".join(
    f"(c{a} * {2 / G}::DOUBLE - 1)::DOUBLE AS {a}0, ((c{a} + 1) * {2 / G}::DOUBLE - 1)::DOUBLE AS {a}1" for a in "xyz")


@query("chunk_summary", f"SELECT summ.*, {BOX} FROM summ")
def chunk_summary(spark, sf):
    return summary(spark, sf)


@query("chunk_colour", "SELECT * FROM ccol")
def chunk_colour(spark, sf):
    return voxels.chunk_colour(records(spark, sf))


@query("compact_side", """
SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) <= 1 THEN 1 WHEN count(*) <= 4 THEN 2 WHEN count(*) <= 16 THEN 4
  WHEN count(*) <= 64 THEN 8 ELSE 16 END::BIGINT AS side FROM lineitem GROUP BY l_orderkey""")
def compact_side(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("side", grid.compact_side(F.col("n")))


@query("side_overflow", "SELECT chunk_id, n_occupied, side FROM summ WHERE side > 4")
def side_overflow(spark, sf):
    return voxels.side_overflow(summary(spark, sf), 4)


@query("tile_slots", """
SELECT v.chunk_id, v.local_id, row_number() OVER (PARTITION BY v.chunk_id ORDER BY v.local_id) - 1 AS slot, s.side,
       (row_number() OVER (PARTITION BY v.chunk_id ORDER BY v.local_id) - 1) % s.side AS tile_col,
       (row_number() OVER (PARTITION BY v.chunk_id ORDER BY v.local_id) - 1) // s.side AS tile_row
FROM vox v JOIN summ s USING (chunk_id)""")
def tile_slots(spark, sf):
    return voxels.tile_slots(voxel_table(spark, sf))


@query("chunk_proxy", f"""
SELECT t.i AS chunk_id, coalesce(n_points, 0) AS n_points, coalesce(n_occupied, 0) AS n_occupied, coalesce(r, 0) AS r,
  coalesce(g, 0) AS g, coalesce(b, 0) AS b, CAST(floor(log2(coalesce(n_points, 0) + 1)) AS BIGINT) AS density_log2
FROM range({G ** 3}) t(i) LEFT JOIN summ s ON s.chunk_id = t.i LEFT JOIN ccol c ON c.chunk_id = t.i""")
def chunk_proxy(spark, sf):
    rec = records(spark, sf)
    return voxels.chunk_proxy(voxels.chunk_summary(rec, G), voxels.chunk_colour(rec), G)


@query("voxel_proxy", "SELECT chunk_id, local_id, n, r, g, b, repr_row_id FROM rec")
def voxel_proxy(spark, sf):
    return voxels.voxel_proxy(records(spark, sf), G, VPC)


@query("derive_voxel_proxy", "SELECT chunk_id, local_id, n, r, g, b, repr_row_id FROM rec")
def derive_voxel_proxy(spark, sf):
    return voxels.derive_voxel_proxy(records(spark, sf), G, VPC)


@query("compare_proxy", """
SELECT count(*) AS n_stored, count(*) AS n_derived, count(*) FILTER (chunk_id % 7 = 3) AS n_only_stored, count(*) FILTER (chunk_id % 7 = 3) AS n_only_derived FROM rec""")
def compare_proxy(spark, sf):
    """A stored proxy with changed counts in every seventh chunk, against the one derived from stored records."""
    root = f"{ensure_checkpoint_dir(spark)}/proxy-{uuid.uuid4().hex}"
    records(spark, sf).write.parquet(f"{root}/records")
    rec = spark.read.parquet(f"{root}/records")
    changed = F.when(F.col("chunk_id") % 7 == 3, F.col("n") + 1).otherwise(F.col("n"))
    voxels.write_voxel_proxy(voxels.voxel_proxy(rec, G, VPC).withColumn("n", changed), f"{root}/proxy")
    return voxels.compare_proxy(spark.read.parquet(f"{root}/proxy"), voxels.derive_voxel_proxy(rec, G, VPC))


@query("check_canonical", """
SELECT l_orderkey AS chunk_id, CAST(l_linenumber AS BIGINT) AS local_id, count(*) AS copies
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def check_canonical(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").cast("long").alias("local_id"))
    return voxels.check_canonical(df)


part("cells", f"""
SELECT v.*, step, local_id % {VPC} // step * step AS cell_x, local_id // {VPC} % {VPC} // step * step AS cell_y,
       local_id // {VPC * VPC} // step * step AS cell_z
FROM rec v, (SELECT unnest([4, 2, 1])::BIGINT AS step)""")
part("bricks_t", """
SELECT chunk_id, step, cell_x, cell_y, cell_z, """ + ", ".join(
    f"CAST(round_even(sum({c} * n) / sum(n), 0) AS BIGINT) AS {c}" for c in "rgb") + """,
  min(local_id) AS repr_local, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY 1, 2, 3, 4, 5""")
part("tree", """
SELECT CAST(l AS BIGINT) AS level, cx >> l AS kx, cy >> l AS ky, cz >> l AS kz, CAST(sum(n_points) AS BIGINT) AS n_points,
       count(*) AS n_chunks
FROM summ, (SELECT unnest([0, 1, 2]) AS l) GROUP BY 1, 2, 3, 4""")


@query("bricks", "SELECT * FROM bricks_t")
def bricks(spark, sf):
    return lod.bricks(records(spark, sf), VPC)


@query("octree", "SELECT * FROM tree")
def octree(spark, sf):
    return lod.octree(summary(spark, sf), G)


@query("octree_edges", """
SELECT p.level, p.kx, p.ky, p.kz, c.kx % 2 * 4 + c.ky % 2 * 2 + c.kz % 2 AS octant, c.n_points AS child_points
FROM tree p JOIN tree c ON c.level + 1 = p.level AND c.kx // 2 = p.kx AND c.ky // 2 = p.ky AND c.kz // 2 = p.kz""")
def octree_edges(spark, sf):
    return lod.octree_edges(lod.octree(summary(spark, sf), G))


@query("cell_max_counts", "SELECT chunk_id, step, cell_x, cell_y, cell_z, max(n) AS max_n FROM cells WHERE step = 2 GROUP BY 1, 2, 3, 4, 5")
def cell_max_counts(spark, sf):
    return lod.cell_max_counts(voxel_table(spark, sf), VPC, 2)


@query("filter_by_count", "SELECT chunk_id, local_id, repr_row_id, n FROM vox WHERE n > 3")
def filter_by_count(spark, sf):
    return lod.filter_by_count(voxel_table(spark, sf), 3)


@query("filter_cells_by_count", """
SELECT chunk_id, step, cell_x, cell_y, cell_z, max(n) AS max_n FROM cells WHERE step = 2 GROUP BY 1, 2, 3, 4, 5 HAVING max(n) > 5""")
def filter_cells_by_count(spark, sf):
    return lod.filter_cells_by_count(voxel_table(spark, sf), VPC, 2, 5)


@query("density_level", """
SELECT chunk_id, local_id, round(least(1, greatest(0, log10(greatest(1, n)) / 4)), 9) AS level FROM vox""")
def density_level(spark, sf):
    return voxel_table(spark, sf).select("chunk_id", "local_id", F.round(grid.density_level(F.col("n")), 9).alias("level"))


@query("densest_chunk", "SELECT chunk_id, n_points FROM summ ORDER BY n_points DESC, chunk_id LIMIT 1")
def densest_chunk(spark, sf):
    return lod.densest_chunk(summary(spark, sf)).select("chunk_id", "n_points")


@query("blank_report", """
SELECT count(*) AS n_voxels, count(*) FILTER (coalesce(n_chars, 0) = 0) AS n_blank,
       count(*) FILTER (coalesce(n_chars, 0) = 0)::DOUBLE / count(*) AS share
FROM vox LEFT JOIN documents ON doc_id = repr_row_id""")
def blank_report(spark, sf):
    payloads = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("n_chars").alias("n_bytes"))
    return voxels.blank_report(voxel_table(spark, sf), payloads)


@query("summary_layout", f"""
SELECT chunk_id, n_occupied, n_occupied * 18 < {16 * VPC ** 3} AS sparse,
  32 + CASE WHEN n_occupied * 18 < {16 * VPC ** 3} THEN n_occupied * 18 ELSE {16 * VPC ** 3} END AS encoded_bytes FROM summ""")
def summary_layout(spark, sf):
    return lod.summary_layout(summary(spark, sf), VPC)


@query("pack_report", """
SELECT CAST(sum(n_points) AS BIGINT) AS n_rows, CAST(sum(n_occupied) AS BIGINT) AS n_voxels, count(*) AS n_chunks,
  max(max_n) AS max_voxel, CAST(sum(n_points) * 33 AS BIGINT) AS row_bytes, CAST(sum(side * side * 4096) AS BIGINT) AS rgba_bytes FROM summ""")
def pack_report(spark, sf):
    return lod.pack_report(summary(spark, sf))


@query("stratified_ratio_estimate", """
SELECT stratum, n_chunks, n_sampled, base_total, round(ratio, 9) AS ratio, round(base_total * ratio, 6) AS estimate FROM (
  SELECT stratum, count(*) AS n_chunks, count(*) FILTER (picked) AS n_sampled, CAST(sum(n_points) AS BIGINT) AS base_total,
         sum(side * side) FILTER (picked)::DOUBLE / sum(n_points) FILTER (picked) AS ratio
  FROM (SELECT *, list_contains([round_even(j * (m - 1) / greatest(least(4, m) - 1, 1), 0)::BIGINT for j in range(least(4, m))], i) AS picked
    FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n_occupied, chunk_id) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS m
      FROM (SELECT *, CASE WHEN n_occupied <= 16 THEN 0 WHEN n_occupied <= 64 THEN 1 WHEN n_occupied <= 256 THEN 2 ELSE 3 END::BIGINT AS stratum
        FROM summ))) GROUP BY stratum)""")
def stratified_ratio_estimate(spark, sf):
    df = summary(spark, sf).select(
        "chunk_id", "n_occupied", F.col("n_points").alias("base"), (F.col("side") * F.col("side")).alias("target"))
    out = lod.stratified_ratio_estimate(df)
    return out.withColumn("ratio", F.round("ratio", 9)).withColumn("estimate", F.round("estimate", 6))
