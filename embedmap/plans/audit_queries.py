"""Audits of the order and event maps, and of deliberately broken copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedmap.functions import codec
from embedmap.operators import audits, lod, minimap, voxels
from embedmap.operators.keys import encode_subset
from embedmap.plans.data import CORPORA, G, GRID, VPC, ZOOM, assigned, frame2, frame3, points2, points3, quantized, records, table
from embedmap.plans.registry import query

PAGE = 512


@query("audit_postings", """
SELECT count(*) AS n_rows, min(row_id) AS min_key, max(row_id) AS max_key, 0::BIGINT AS n_duplicated, true AS dense FROM post""")
def audit_postings(spark, sf):
    return audits.audit_postings(voxels.postings(assigned(spark, sf)), table(spark, sf, "orders").count())


@query("audit_offsets", """
SELECT chunk_id, local_id, 'offset' AS problem FROM rec WHERE chunk_id = 3 AND point_offset > 0
UNION ALL SELECT chunk_id, -1, 'chunk total' FROM summ WHERE chunk_id = 4""")
def audit_offsets(spark, sf):
    """Offsets are shifted in one chunk, the total is wrong in another."""
    rec = records(spark, sf)
    summary = voxels.chunk_summary(rec, G).withColumn("n_points", F.when(F.col("chunk_id") == 4, F.col("n_points") + 1).otherwise(F.col("n_points")))
    shifted = F.when((F.col("chunk_id") == 3) & (F.col("point_offset") > 0), F.col("point_offset") + 1).otherwise(F.col("point_offset"))
    return audits.audit_offsets(rec.withColumn("point_offset", shifted), summary)


@query("audit_representatives", "SELECT chunk_id, local_id, repr_row_id + 1 AS row_id FROM vox WHERE chunk_id = 2 AND (chunk_id, local_id, repr_row_id + 1) NOT IN (SELECT (chunk_id, local_id, row_id) FROM post)")
def audit_representatives(spark, sf):
    placed = assigned(spark, sf)
    rec = voxels.representatives(placed, GRID)
    moved = F.when(F.col("chunk_id") == 2, F.col("repr_row_id") + 1).otherwise(F.col("repr_row_id"))
    return audits.audit_representatives(rec.withColumn("repr_row_id", moved), voxels.postings(placed))


@query("posting_order_violations", "SELECT chunk_id, local_id, row_id - 5000 AS row_id, pos FROM post p WHERE chunk_id = 1 AND pos = 1 AND row_id - 5000 <= (SELECT row_id FROM post q WHERE q.chunk_id = p.chunk_id AND q.local_id = p.local_id AND q.pos = 0)")
def posting_order_violations(spark, sf):
    p = voxels.postings(assigned(spark, sf))
    broken = F.when((F.col("chunk_id") == 1) & (F.col("pos") == 1), F.col("row_id") - 5000).otherwise(F.col("row_id"))
    return audits.posting_order_violations(p.withColumn("row_id", broken))


@query("audit_assignment", "SELECT row_id, 0::BIGINT AS chunk_id, local_id FROM a3 WHERE subset = '5-LOW' AND chunk_id <> 0")
def audit_assignment(spark, sf):
    points, frame = points3(spark, sf), frame3(spark, sf)
    stored = assigned(spark, sf).withColumn("chunk_id", F.when(F.col("subset") == "5-LOW", 0).otherwise(F.col("chunk_id")).cast("long"))
    return audits.audit_assignment(points, stored, frame, GRID, VPC)


@query("audit_xy", "SELECT row_id, qx + 1 AS qx, qy FROM z2 WHERE corpus = 1")
def audit_xy(spark, sf):
    frame = frame2(spark, sf)
    stored = quantized(spark, sf).withColumn("qx", F.when(F.col("corpus") == 1, F.col("qx") + 1).otherwise(F.col("qx")))
    return audits.audit_xy(points2(spark, sf), stored, frame)


@query("audit_point_index", "SELECT event_id AS row_id FROM events WHERE event_type = 'view'")
def audit_point_index(spark, sf):
    df = encode_subset(table(spark, sf, "events"), "event_type", CORPORA)
    ref = codec.pack_ref(F.col("user_id"), F.col("event_id") % 65536)
    points = df.select(F.col("event_id").alias("row_id"), ref.alias("ref"), "code")
    index = points.withColumn("code", F.when(F.col("code") == 4, 3).otherwise(F.col("code")).cast("long"))
    return audits.audit_point_index(points, index)


@query("audit_spatial", f"""
SELECT row_id AS key, 'row differs' AS problem FROM spat WHERE corpus = 2
UNION ALL SELECT DISTINCT pos // {PAGE}, 'page bounds' FROM til WHERE pos // {PAGE} = 3""")
def audit_spatial(spark, sf):
    """The corpus of some rows is wrong, and so is the box of one page."""
    tiled, placed = minimap.points_tiled(quantized(spark, sf), ZOOM), assigned(spark, sf)
    rows = minimap.spatial_rows(tiled, placed)
    pages = minimap.spatial_pages(rows, PAGE).withColumn("x1", F.when(F.col("page") == 3, F.col("x1") + 1).otherwise(F.col("x1")))
    wrong = rows.withColumn("corpus", F.when(F.col("corpus") == 2, 9).otherwise(F.col("corpus")).cast("long"))
    known = placed.join(tiled.select("row_id"), "row_id", "left_semi")
    return audits.audit_spatial(wrong, pages, tiled, known, PAGE)


@query("audit_conservation", """
SELECT 'step ' || step AS level, chunk_id AS key FROM (SELECT DISTINCT chunk_id, step FROM bricks_t WHERE step = 2 AND chunk_id = 6)
UNION ALL SELECT 'tree 1', kx FROM tree WHERE level = 1 AND kx = 0 UNION ALL SELECT 'tree 2', kx FROM tree WHERE level = 2
UNION ALL SELECT 'tree total 1', CAST(sum(n_points) + count(*) FILTER (kx = 0) AS BIGINT) FROM tree WHERE level = 1""")
def audit_conservation(spark, sf):
    """One brick step of one chunk and the octree nodes of one half are off by one."""
    rec = records(spark, sf)
    summary = voxels.chunk_summary(rec, G)
    more = F.when((F.col("step") == 2) & (F.col("chunk_id") == 6), F.col("n") + 1).otherwise(F.col("n"))
    tree = lod.octree(summary, G)
    tree = tree.withColumn("n_points", F.when((F.col("level") == 1) & (F.col("kx") == 0), F.col("n_points") + 1).otherwise(F.col("n_points")))
    return audits.audit_conservation(lod.bricks(rec, VPC).withColumn("n", more), tree, summary, table(spark, sf, "orders").count())


@query("audit_voxel_proxy", """
SELECT chunk_id, 'row right' AS problem FROM rec WHERE chunk_id = 8 UNION ALL SELECT 8, 'run length'""")
def audit_voxel_proxy(spark, sf):
    """The proxy lacks one chunk."""
    rec = records(spark, sf)
    proxy = voxels.voxel_proxy(rec, G, VPC).filter(F.col("chunk_id") != 8)
    return audits.audit_voxel_proxy(proxy, rec, voxels.chunk_summary(rec, G))


@query("audit_report", """
SELECT CAST(sum(n_points) AS BIGINT) AS points, CAST(sum(n_occupied) AS BIGINT) AS occupied_voxels, count(*) AS chunks, max(max_n) AS max_voxel,
  (SELECT count(*) FROM tree) AS hierarchy_nodes, 0::BIGINT AS offset_problems, 0::BIGINT AS stray_representatives, true AS rows_once FROM summ""")
def audit_report(spark, sf):
    rec = records(spark, sf)
    summary = voxels.chunk_summary(rec, G)
    return audits.audit_report(voxels.postings(assigned(spark, sf)), rec, summary, lod.octree(summary, G), table(spark, sf, "orders").count())


@query("audit_projection_pair", """
SELECT 'pool' AS corpus, event_id AS row_id, 'right' AS side FROM events WHERE event_id NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'pool', k, 'left' FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k NOT IN (SELECT event_id FROM events)""")
def audit_projection_pair(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("pool").alias("corpus"), F.col("o_custkey").alias("row_id")).distinct()
    b = table(spark, sf, "events").select(F.lit("pool").alias("corpus"), F.col("event_id").alias("row_id"))
    return audits.audit_projection_pair(a, b)
