from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.operators import audits, frames, lod, voxels
from tests.conftest import rows

N, VPC, G = 32, 16, 2


def points(spark, n=2000, hot=0.0):
    rng = np.random.default_rng(42)
    xyz = rng.normal(size=(n, 3))
    xyz[0], xyz[1] = 1000, -1000
    if hot:
        xyz[2 : 2 + int(n * hot)] = 0.1
    return spark.createDataFrame(
        [(i, *map(float, p), i % 256, i * 3 % 256, i * 7 % 256) for i, p in enumerate(xyz)],
        "row_id long, x double, y double, z double, r long, g long, b long")


@pytest.fixture(scope="module")
def pack(spark):
    pts = points(spark)
    frame = frames.compute_frame_3d(pts)
    placed = frames.assign_points(pts, frame, N, VPC).cache()
    vox = voxels.representatives(placed, N).cache()
    rec = voxels.voxel_records(vox, pts).cache()
    return {"points": pts, "frame": frame, "placed": placed, "voxels": vox, "records": rec, "summary": voxels.chunk_summary(rec, G).cache(),
            "postings": voxels.postings(placed).cache()}


def test_nearest_to_the_centre_then_lowest_row(spark):
    data = [(0, -.75, -.5, -.5), (1, -.25, -.5, -.5), (2, .49, .49, .49), (3, .70, .50, .50)]
    df = spark.createDataFrame(data, "row_id long, x double, y double, z double")
    placed = frames.assign_points(df, frames.Frame([-1.0, 1.0] * 3, [-1.0, 1.0] * 3), 2, 1)
    assert rows(voxels.representatives(placed, 2), "chunk_id", "local_id", "repr_row_id", "n") == [(0, 0, 0, 2), (7, 0, 2, 2)]


def test_representatives_match_brute_force(pack):
    best: dict = {}
    for r in pack["placed"].collect():
        c = [(v + .5) * 2 / N - 1 for v in (r.vx, r.vy, r.vz)]
        d = sum((p - q) ** 2 for p, q in zip((r.px, r.py, r.pz), c))
        key = (r.chunk_id, r.local_id)
        best.setdefault(key, []).append((d, r.row_id))
    want = sorted((*k, min(v)[1], len(v)) for k, v in best.items())
    assert rows(pack["voxels"], "chunk_id", "local_id", "repr_row_id", "n") == want


def test_every_audit_is_clean(pack):
    n = pack["points"].count()
    assert audits.audit_postings(pack["postings"], n).first().dense
    assert audits.audit_offsets(pack["records"], pack["summary"]).isEmpty()
    assert audits.audit_representatives(pack["records"], pack["postings"]).isEmpty()
    assert audits.posting_order_violations(pack["postings"]).isEmpty()
    assert audits.audit_assignment(pack["points"], pack["placed"], pack["frame"], N, VPC).isEmpty()
    tree, bricks = lod.octree(pack["summary"], G), lod.bricks(pack["records"], VPC)
    assert audits.audit_conservation(bricks, tree, pack["summary"], n).isEmpty()
    proxy = voxels.voxel_proxy(pack["records"], G, VPC)
    assert audits.audit_voxel_proxy(proxy, pack["records"], pack["summary"]).isEmpty()
    report = audits.audit_report(pack["postings"], pack["records"], pack["summary"], tree, n).first()
    assert report.points == n and report.rows_once and report.offset_problems == 0 and report.stray_representatives == 0


def test_corrupted_tables_are_found(pack):
    broken = pack["postings"].filter("row_id <> 17").unionByName(pack["postings"].filter("row_id = 18"))
    assert not audits.audit_postings(broken, 2000).first().dense
    assert audits.audit_representatives(pack["records"], pack["postings"].filter("chunk_id <> 0")).count() > 0


@pytest.mark.parametrize("parts", [1, 7])
def test_layout_independence(spark, pack, parts):
    again = frames.assign_points(pack["points"].repartition(parts), pack["frame"], N, VPC)
    assert rows(voxels.representatives(again, N)) == rows(pack["voxels"])
    assert rows(voxels.postings(again, hot_rows=3, split_bits=3)) == rows(pack["postings"])


def test_a_voxel_with_a_third_of_all_rows(spark):
    pts = points(spark, 1500, hot=1 / 3)
    placed = frames.assign_points(pts, frames.Frame([-4.0, 4.0] * 3, [-4.0, 4.0] * 3), 8, 4)
    split = voxels.postings(placed, hot_rows=100, split_bits=4)
    assert rows(split) == rows(voxels.postings(placed))
    assert audits.posting_order_violations(split).isEmpty()


def test_lod_fixture(spark):
    rec = spark.createDataFrame([(0, 0, 150, 100, 120, 140), (0, 4095, 50, 200, 40, 60)], "chunk_id long, local_id long, n long, r long, g long, b long")
    got = rows(lod.bricks(rec, 16).groupBy("step").agg(F.sum("n").alias("n")), "step", "n")
    assert got == [(1, 200), (2, 200), (4, 200)]
    one = lod.bricks(rec.withColumn("local_id", F.when(F.col("local_id") == 4095, 17).otherwise(0).cast("long")), 16, (2,)).first()
    assert (one.n, one.r, one.g, one.b, one.repr_local) == (200, 125, 100, 120, 0)


def test_half_even_colour(spark):
    rec = spark.createDataFrame([(0, 0, 1, 0, 1, 2), (0, 1, 1, 1, 2, 3)], "chunk_id long, local_id long, n long, r long, g long, b long")
    assert voxels.chunk_colour(rec).first()[1:] == (0, 2, 2)


def test_wide_counts_survive(spark):
    vox = spark.createDataFrame([(0, 3, 99_999_999, 1_000_000)], "chunk_id long, local_id long, repr_row_id long, n long")
    assert voxels.voxel_offsets(vox).first().n == 1_000_000
    assert voxels.occupancy_overflow(vox).first().n == 1_000_000


def test_coarse_cells_by_maximum_never_sum(spark):
    vox = spark.createDataFrame([(0, 0, 2), (0, 1, 2), (0, 3, 5)], "chunk_id long, local_id long, n long")
    assert rows(lod.filter_cells_by_count(vox, 4, 2, 3), "cell_x", "max_n") == [(2, 5)]
    assert lod.threshold(-1) == 1 and lod.threshold("x") == 1 and lod.threshold(True) == 1 and lod.threshold(0) == 0


def test_chunk_proxy_is_dense(pack):
    out = voxels.chunk_proxy(pack["summary"], voxels.chunk_colour(pack["records"]), G)
    assert out.count() == G**3 and out.agg(F.sum("n_points")).first()[0] == 2000


def test_voxel_proxy_round_trip_and_bounds(spark, pack, scratch):
    proxy = voxels.voxel_proxy(pack["records"], G, VPC)
    voxels.write_voxel_proxy(proxy, f"{scratch}/proxy")
    stored = spark.read.parquet(f"{scratch}/proxy")
    derived = voxels.derive_voxel_proxy(pack["records"], G, VPC)
    assert voxels.table_difference(stored, derived).isEmpty() and voxels.check_canonical(stored).isEmpty()
    with pytest.raises(Exception, match="outside the grid"):
        voxels.voxel_proxy(pack["records"].withColumn("chunk_id", F.lit(99).cast("long")), G, VPC).collect()
