"""3-D queries over the voxels of the order points; probes are derived from the suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedmap.operators import spatial
from embedmap.plans.data import G, GRID, VPC, summary, table, voxel_table
from embedmap.plans.registry import part, query

# Camera poses are parameters: id, position, unit direction.
POSES = [(0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 0.6, -0.4, 0.1, 0.6, 0.8, 0.0), (2, -1.5, 0.2, 0.9, 1.0, 0.0, 0.0)]


def probes(spark, sf):
    axis = lambda i: F.when(F.col("s_nationkey") % 3 == i, 1.0).otherwise(0.0)
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("q"),
        ((F.col("s_suppkey") * 37 % 256) / 100.0 - 1.28).alias("px"),
        ((F.col("s_suppkey") * 91 % 256) / 100.0 - 1.28).alias("py"),
        ((F.col("s_nationkey") * 53 % 256) / 100.0 - 1.28).alias("pz"),
        axis(0).alias("fx"), axis(1).alias("fy"), axis(2).alias("fz"))


part("prb", f"""
SELECT q, (px + 1) * {GRID / 2}::DOUBLE AS ux, (py + 1) * {GRID / 2}::DOUBLE AS uy, (pz + 1) * {GRID / 2}::DOUBLE AS uz, f FROM (
  SELECT s_suppkey AS q, (s_suppkey * 37 % 256) / 100.0::DOUBLE - 1.28::DOUBLE AS px, (s_suppkey * 91 % 256) / 100.0::DOUBLE - 1.28::DOUBLE AS py,
    (s_nationkey * 53 % 256) / 100.0::DOUBLE - 1.28::DOUBLE AS pz, s_nationkey % 3 AS f FROM supplier)""")
part("vctr", f"""
SELECT chunk_id, local_id, n, (chunk_id % {G}) * {VPC} + local_id % {VPC} + 0.5::DOUBLE AS x,
  (chunk_id // {G} % {G}) * {VPC} + local_id // {VPC} % {VPC} + 0.5::DOUBLE AS y, (chunk_id // {G * G}) * {VPC} + local_id // {VPC * VPC} + 0.5::DOUBLE AS z FROM vox""")
part("pv", """
SELECT q, f, chunk_id, local_id, n, x - ux AS dx, y - uy AS dy, z - uz AS dz, (x - ux) * (x - ux) + (y - uy) * (y - uy) + (z - uz) * (z - uz) AS d2 FROM vctr, prb""")


@query("voxels_in_sphere", f"SELECT q, chunk_id, local_id, n, round(d2 * {(2 / GRID) ** 2!r}::DOUBLE, 9) AS d2 FROM pv WHERE d2 <= 2.4::DOUBLE * 2.4::DOUBLE")
def voxels_in_sphere(spark, sf):
    out = spatial.voxels_in_sphere(voxel_table(spark, sf), probes(spark, sf), 0.3, GRID, VPC)
    return out.withColumn("d2", F.round("d2", 9))


@query("voxels_in_shell", f"""
SELECT q, rank, chunk_id, local_id, n, priority * {2 / GRID!r}::DOUBLE AS priority FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY priority, chunk_id, local_id) AS rank FROM (
    SELECT *, round(sqrt(d2) * (1 - 0.5::DOUBLE * (CASE f WHEN 0 THEN dx WHEN 1 THEN dy ELSE dz END) / sqrt(d2)), 9) AS priority
    FROM pv WHERE d2 > 2.4::DOUBLE * 2.4::DOUBLE AND d2 <= 3.4::DOUBLE * 3.4::DOUBLE))""")
def voxels_in_shell(spark, sf):
    return spatial.voxels_in_shell(voxel_table(spark, sf), probes(spark, sf), 0.3, GRID, VPC)


@query("nearest_voxel", f"""
SELECT q, chunk_id, local_id, round(sqrt(d2) * {2 / GRID!r}::DOUBLE, 9) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, chunk_id, local_id) AS k FROM pv) WHERE k = 1""")
def nearest_voxel(spark, sf):
    return spatial.nearest_voxel(voxel_table(spark, sf), probes(spark, sf), GRID, VPC).withColumn("distance", F.round("distance", 9))


part("pose", "SELECT * FROM (VALUES " + ", ".join(
    f"({p[0]}::BIGINT, " + ", ".join(f"{v}::DOUBLE" for v in p[1:]) + ")" for p in POSES) + ") t(q, px, py, pz, fx, fy, fz)")
part("pc", """
SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS distance FROM (SELECT pose.*, chunk_id, """ + ", ".join(
    f"c{a} + 0.5::DOUBLE - (p{a} + 1) * {G / 2}::DOUBLE AS d{a}" for a in "xyz") + " FROM summ, pose)")


@query("ring_tiers", """
SELECT q, chunk_id, round(distance, 9) AS distance, CASE WHEN distance <= 1.2 THEN 'load' WHEN distance <= 2 THEN 'prefetch' WHEN distance <= 3 THEN 'keep' ELSE 'evict' END AS tier FROM pc""")
def ring_tiers(spark, sf):
    return spatial.ring_tiers(summary(spark, sf), POSES, (1.2, 2.0, 3.0), G).withColumn("distance", F.round("distance", 9))


@query("chunk_priority", """
SELECT q, rank, chunk_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY priority, chunk_id) AS rank FROM (
  SELECT *, round(distance * (1 - 0.35::DOUBLE * CASE WHEN distance = 0 THEN 0 ELSE (dx * fx + dy * fy + dz * fz) / distance END), 9) AS priority FROM pc)) WHERE rank <= 20""")
def chunk_priority(spark, sf):
    return spatial.chunk_priority(summary(spark, sf), POSES, G, 20)
