"""Builds that are published, read back and compared. They write below the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from embedmap.operators import build
from embedmap.plans.data import GRID, VPC, points3
from embedmap.plans.registry import query
from embedmap.session import ensure_checkpoint_dir
from embedmap.sources import release


def _root(spark):
    return f"{ensure_checkpoint_dir(spark)}/releases-{uuid.uuid4().hex}"


@query("publish_map", "SELECT chunk_id, local_id, n, repr_row_id FROM vox")
def publish_map(spark, sf):
    """Voxels of a map that was built, audited, published and read back."""
    root = _root(spark)
    build.build_map(points3(spark, sf), root, "r1", GRID, VPC)
    return release.read_release(spark, root, "r1")["voxels"].select("chunk_id", "local_id", "n", "repr_row_id")


@query("publish_points", "SELECT row_id, subset, r, g, b, r + 1 AS extra FROM p3")
def publish_points(spark, sf):
    """A points table that is published, and published again with a new column under the contract of the first."""
    root, points = _root(spark), points3(spark, sf).select("row_id", "subset", "r", "g", "b")
    contract = ["row_id", "subset", "r", "g", "b"]
    release.write_points_table(points, root, "r1", contract)
    release.write_points_table(points.withColumn("extra", F.col("r") + 1), root, "r2", contract)
    return release.read_release(spark, root, release.current_release(spark, root))["points"]


@query("release_rows", """
SELECT 'points' AS name, count(*) AS n_rows FROM p3 UNION ALL SELECT 'postings', count(*) FROM p3 UNION ALL SELECT 'voxels', count(*) FROM vox
UNION ALL SELECT 'records', count(*) FROM vox UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM vox""")
def release_rows(spark, sf):
    """Row counts of a published manifest."""
    root = _root(spark)
    build.build_map(points3(spark, sf), root, "r1", GRID, VPC)
    wanted = ["points", "postings", "voxels", "records", "chunks"]
    return release.read_manifest(spark, root, "r1").filter(F.col("name").isin(wanted)).select("name", "n_rows")
