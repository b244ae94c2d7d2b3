from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from embedmap.functions import grid
from embedmap.operators import audits, frames, lod, metadata, minimap, spatial, voxels
from tests.conftest import rows

N, VPC = 16, 4


@pytest.fixture(scope="module")
def vox(spark):
    rng = random.Random(1)
    cells = sorted(rng.sample(range(N**3), 300))
    df = spark.createDataFrame([(c, rng.randint(1, 9)) for c in cells], "idx long, n long")
    df = df.withColumns({k: a for k, a in zip(("vx", "vy", "vz"), grid.axes_of(F.col("idx"), N))})
    return frames.address(df, N, VPC).select("chunk_id", "local_id", "n", "vx", "vy", "vz").cache()


def probes(spark):
    data = [(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, -1.7, 0.3, 0.9, 0.0, 1.0, 0.0), (2, 0.51, -0.49, 0.2, 0.0, 0.0, -1.0), (3, 5.0, 5.0, -5.0, 0.0, 0.6, 0.8)]
    return spark.createDataFrame(data, "q long, px double, py double, pz double, fx double, fy double, fz double")


def local(vox):
    return [(r.chunk_id, r.local_id, r.n, tuple((v + .5) * 2 / N - 1 for v in (r.vx, r.vy, r.vz))) for r in vox.collect()]


def test_sphere_shell_and_nearest_match_brute_force(spark, vox):
    table, ps = local(vox), probes(spark).collect()
    d = lambda p, v: math.dist((p.px, p.py, p.pz), v[3])
    r = 0.4
    sphere = rows(spatial.voxels_in_sphere(vox, probes(spark), r, N, VPC), "q", "chunk_id", "local_id")
    assert sphere == sorted((p.q, v[0], v[1]) for p in ps for v in table if d(p, v) ** 2 <= r * r)
    shell = rows(spatial.voxels_in_shell(vox, probes(spark), r, N, VPC, slots=7), "q", "rank", "chunk_id", "local_id")
    want = []
    for p in ps:
        near = []
        for v in table:
            if r < d(p, v) <= r + 2 / N:
                ahead = sum((b - a) * f for a, b, f in zip((p.px, p.py, p.pz), v[3], (p.fx, p.fy, p.fz))) / d(p, v)
                near.append((round(d(p, v) * N / 2 * (1 - .5 * ahead), 9), v[0], v[1]))
        want += [(p.q, i + 1, c, l) for i, (_, c, l) in enumerate(sorted(near)[:7])]
    assert shell == sorted(want)
    for bits in (0, 1, 2, 4):
        got = rows(spatial.nearest_voxel(vox, probes(spark), N, VPC, bits), "q", "distance")
        assert all(math.isclose(g[1], min(d(p, v) for v in table)) for g, p in zip(got, ps))


def test_tiers_and_priorities(spark, vox):
    summary = voxels.chunk_summary(vox.withColumn("repr_row_id", F.lit(0)), N // VPC)
    pose = [(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    tiers = spatial.ring_tiers(summary, pose, (1.0, 2.0, 2.5), N // VPC)
    for r in tiers.collect():
        assert r.tier == ("load" if r.distance <= 1 else "prefetch" if r.distance <= 2 else "keep" if r.distance <= 2.5 else "evict")
    first = rows(spatial.chunk_priority(summary, pose, N // VPC, 3), "rank", "chunk_id")
    ahead = {r.chunk_id for r in summary.filter("cx = 2").collect()}
    assert first[0][1] in ahead


# --- plans ------------------------------------------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, scratch):
    data = [(i, "covers" if i % 2 else "plates", 1800 + i % 50, f"{i % 9:09d}", i % 4, i % 8) for i in range(200)]
    spark.createDataFrame(data, "row_id long, subset string, year int, book string, chunk_id long, local_id long").write.parquet(f"{scratch}/images")
    images = spark.read.parquet(f"{scratch}/images")
    counts = metadata.filter_counts(metadata.filter_rows(images, {"type": "covers", "minYear": 1810}, ("covers", "plates")))
    text = plan(counts)
    assert "EqualTo(subset,covers)" in text and "GreaterThanOrEqual(year,1810)" in text
    schema = text.split("ReadSchema:")[1].splitlines()[0]
    assert "book" not in schema and "row_id" not in schema


def test_assignment_is_one_narrow_stage(spark):
    pts = spark.range(100).select(F.col("id").alias("row_id"), *[(F.col("id") / 100.0).alias(c) for c in "xyz"])
    f = frames.Frame([0.0, 1.0] * 3, [0.0, 1.0] * 3)
    text = plan(frames.assign_points(pts, f, N, VPC).select("row_id", "chunk_id", "local_id"))
    assert "Exchange" not in text and "Python" not in text


def test_aggregations_combine_before_the_shuffle(spark):
    q = spark.range(100).select(F.col("id").alias("qx"), F.col("id").alias("qy"), F.lit(0).cast("long").alias("corpus"))
    assert "partial_count" in plan(minimap.density_finest(q, 3))
    pts = spark.range(100).select(F.col("id").alias("row_id"), *[(F.col("id") / 100.0).alias(c) for c in "xyz"])
    placed = frames.assign_points(pts, frames.Frame([0.0, 1.0] * 3, [0.0, 1.0] * 3), N, VPC)
    assert "partial_min" in plan(voxels.representatives(placed, N))


def test_no_cartesian_products(spark, vox):
    frames_ = [
        spatial.voxels_in_sphere(vox, probes(spark), 0.4, N, VPC), spatial.nearest_voxel(vox, probes(spark), N, VPC),
        lod.octree_edges(lod.octree(voxels.chunk_summary(vox.withColumn("repr_row_id", F.lit(0)), N // VPC), N // VPC)),
    ]
    for df in frames_:
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_repeated_rows_are_counted_on_the_way_to_the_lookups(spark, scratch):
    """A repeated row is told once, whatever the lookups hold, and no pass reads the row ids alone."""
    def stored(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{scratch}/{name}")
        return spark.read.parquet(f"{scratch}/{name}")

    lookups = "pos long, qx long, qy long, corpus long, row_id long"
    tiled = stored("tiled", [(i, i, i, 0, i) for i in (1, 2, 3, 4, 5, 7)] + [(90, 2, 2, 0, 2), (4, 4, 4, 0, 4)], lookups)
    known = stored("known", [(i, 10 + i, 20 + i) for i in range(1, 9)], "row_id long, chunk_id long, local_id long")
    mine = lambda i, key: (i, i, i, 0, key, 10 + i, 20 + i)
    table = stored("rows", [mine(i, i) for i in (1, 2, 3, 3, 4, 4, 9)] + [(5, 5, 6, 0, 5, 15, 25), mine(8, None), mine(8, None)], lookups + ", chunk_id long, local_id long")
    found = audits.audit_spatial(table, minimap.spatial_pages(table, 4), tiled, known, 4)
    assert "ReadSchema: struct<row_id:bigint>" not in plan(found)
    assert Counter(tuple(r) for r in found.collect()) == {
        (2, "row differs"): 1, (3, "row repeated"): 1, (4, "row repeated"): 1, (5, "row differs"): 1, (7, "row differs"): 1, (9, "row differs"): 1,
        (None, "row differs"): 2, (None, "row repeated"): 1}
