from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.operators import discs, frames, gridsearch, minimap
from tests.conftest import broadcasts, rows

ZOOM = 2


def quantised(spark, n=3000, hot=0):
    rng = np.random.default_rng(7)
    q = rng.integers(0, 65536, size=(n, 2))
    q[:hot] = (30000, 40000)
    return spark.createDataFrame([(i, i % 3, int(a), int(b)) for i, (a, b) in enumerate(q)], "row_id long, corpus long, qx long, qy long")


def test_frame_and_quantisation(spark):
    rng = np.random.default_rng(7)
    xy = rng.normal(size=(5000, 2))
    xy[0], xy[1] = 500, -500
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "row_id long, x double, y double")
    f = frames.compute_frame_2d(df)
    assert f.extent[1] - f.extent[0] == pytest.approx(f.extent[3] - f.extent[2]) and f.extent[1] < 10
    q = frames.quantize(df, f)
    assert q.agg(F.min("qx"), F.max("qx"), F.min("qy"), F.max("qy")).first()[:] == (0, 65535, 0, 65535)
    top = q.orderBy("qy", F.desc("y")).first()
    assert top.y == pytest.approx(500)  # y is measured downward


def test_overview_counts_beyond_16_bits(spark):
    df = spark.range(100_001).select(F.col("id").alias("row_id"), F.lit(0).alias("corpus"),
                                     *[F.when(F.col("id") < 100_000, 0).otherwise(65535).cast("long").alias(c) for c in ("qx", "qy")])
    assert rows(minimap.overview_density(df), "bin_x", "bin_y", "n") == [(0, 0, 100_000), (511, 511, 1)]


def test_every_level_keeps_all_points(spark):
    q = quantised(spark)
    pyr = minimap.density_pyramid(minimap.density_finest(q, ZOOM), ZOOM)
    assert rows(pyr.groupBy("z").agg(F.sum("n").alias("n"))) == [(z, 3000) for z in range(ZOOM + 1)]
    assert all(r.ok for r in minimap.validate_minimap(q, pyr, minimap.tile_offsets(q, ZOOM), 3000).collect())
    assert not all(r.ok for r in minimap.validate_minimap(q.limit(2999), pyr, minimap.tile_offsets(q, ZOOM), 3000).collect())


@pytest.mark.parametrize("hot", [0, 1000])
def test_tiled_order_and_pages(spark, hot):
    q = quantised(spark, hot=hot)
    tiled = minimap.points_tiled(q, ZOOM, hot_rows=200, split_bits=5)
    want = [r.row_id for r in minimap.with_tile(q, ZOOM).orderBy("tile", "morton", "row_id").collect()]
    got = [r.packed & (2**28 - 1) for r in minimap.packed_points(tiled).orderBy("pos").collect()]
    assert got == want
    pages = minimap.spatial_pages(tiled, 100)
    assert rows(pages, "page", "start", "n") == [(i, i * 100, 100) for i in range(30)]


def brute_cap(counts, budget):
    return max([c for c in range(1, max(counts) + 1) if sum(min(n, c) for n in counts) <= budget], default=1)


@pytest.mark.parametrize("counts,budget", [([1, 1, 1], 3), ([5, 1, 9], 15), ([5, 1, 9], 10), ([5, 1, 9], 7), ([5, 1, 9], 3), ([4, 4], 1), ([100, 1, 50], 77)])
def test_cap_for_budget(spark, counts, budget):
    df = spark.createDataFrame([(c,) for c in counts], "n long")
    assert minimap.cap_for_budget(df, F.lit(budget)).first().cap == brute_cap(counts, budget)


@pytest.mark.parametrize("limit", [40, 300])
def test_lod_matches_a_direct_selection(spark, limit):
    q = quantised(spark, 2000, hot=700)
    local = [(r.row_id, r.qx, r.qy, r.prio) for r in minimap.lod_select(q, ZOOM, 11, 2000, limit, hot_rows=100).collect()]
    from embedmap.operators.ordering import md5_priority

    all_rows = [(r.row_id, r.qx, r.qy, r.prio) for r in q.withColumn("prio", md5_priority(11, "row_id")).collect()]
    budget = min(500, limit)
    at = lambda v, z: v >> (8 - z)
    bins = lambda z: {(at(x, z), at(y, z)) for _, x, y, _ in all_rows}
    stratum = max((z for z in range(ZOOM + 1) if len(bins(z)) <= budget), default=0)
    groups: dict = {}
    for r in sorted(all_rows, key=lambda r: (r[3], r[0])):
        groups.setdefault((at(r[1], stratum), at(r[2], stratum)), []).append(r)
    cap = brute_cap([len(v) for v in groups.values()], budget)
    picked = sorted((i, r[3], r[0], r) for v in groups.values() for i, r in enumerate(v) if i < cap)[:budget]
    assert sorted(local) == sorted(p[3] for p in picked)

    sel = minimap.lod_select(q, ZOOM, 11, 2000, limit, hot_rows=100)
    shown = {r.row_id: r.min_zoom for r in minimap.lod_min_zoom(sel, ZOOM, budget).collect()}
    want, previous = {r[0]: ZOOM for r in local}, 0
    for z in range(ZOOM):
        cells: dict = {}
        for r in sorted(local, key=lambda r: (r[3], r[0])):
            cells.setdefault((at(r[1], z), at(r[2], z)), []).append(r[0])
        previous = max(previous, brute_cap([len(v) for v in cells.values()], max(1, budget // 4 ** (ZOOM - z))))
        for v in cells.values():
            for i in v[:previous]:
                want[i] = min(want[i], z)
    assert shown == want


def test_nearest_and_radius_match_brute_force(spark):
    q = quantised(spark, 400)
    pts = [(r.row_id, r.qx, r.qy) for r in q.collect()]
    asks = [(0, 0, 0), (1, 65535, 100), (2, 30000, 30000), (3, -90000, 500), (4, 70000, 200000), (5, pts[9][1], pts[9][2])]
    qs = spark.createDataFrame(asks, "q long, qx long, qy long")
    d = lambda a, p: (a[1] - p[1]) ** 2 + (a[2] - p[2]) ** 2
    want = sorted((a[0], *min((float(d(a, p)), p[0]) for p in pts)) for a in asks)
    for bits in (6, 10, 14):
        assert rows(minimap.nearest_rows(q, qs, bits), "q", "d2", "row_id") == want
    inside = sorted((a[0], p[0]) for a in asks for p in pts if d(a, p) <= 8000**2)
    assert rows(minimap.rows_in_radius(q, qs, 8000), "q", "row_id") == inside
    capped = rows(minimap.rows_in_radius(q, qs, 8000, 2), "q", "row_id")
    assert capped == sorted((a[0], p[0]) for a in asks for p in sorted((p for p in pts if d(a, p) <= 8000**2), key=lambda p: (d(a, p), p[0]))[:2])


def test_nearest_ties_take_the_lowest_row(spark):
    q = spark.createDataFrame([(5, 10, 10), (3, 20, 10), (9, 10, 20)], "row_id long, qx long, qy long")
    qs = spark.createDataFrame([(0, 15, 10)], "q long, qx long, qy long")
    assert minimap.nearest_rows(q, qs).first().row_id == 3


def joined_rows(df) -> int:
    """Rows that left the largest join of an executed query."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
        if name.endswith("Join"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_nearest_meets_cells_not_rows(spark):
    """The rows of a crowded cell meet a query as one row, and cells get smaller as the positions become more."""
    q = spark.range(2000).selectExpr("id as row_id", "id % 50 + 100 as qx", "id div 50 + 100 as qy")
    qs = spark.range(30).selectExpr("id as q", "100 + id as qx", "120 as qy")
    got = minimap.nearest_rows(q, qs, 8)
    assert rows(got, "q", "d2", "row_id") == [(i, 0.0, 20 * 50 + i) for i in range(30)]
    assert joined_rows(got) <= 30 * 4
    assert [gridsearch.cell_bits_for(n, 2, 16, 2, 8) for n in (0, 100_000, 1 << 20, 36_000_000, 10**12)] == [8, 8, 7, 4, 2]
    assert rows(minimap.nearest_rows(q, qs), "q", "row_id") == [(i, 20 * 50 + i) for i in range(30)]


def test_radius_meets_few_rows_beyond_it(spark):
    """The join of all rows within a radius meets less than twice as many pairs as are in the answer."""
    q = spark.range(40_000).selectExpr("id as row_id", "id % 200 * 100 as qx", "id div 200 * 100 as qy")
    qs = spark.createDataFrame([(0, 9950, 10050), (1, 12000, 9000), (2, 8111, 8222)], "q long, qx long, qy long")
    got = gridsearch.within(q, qs, ["qx", "qy"], ["qx", "qy"], "q", 3000, fine=minimap.RADIUS_CELLS)
    cells = gridsearch.within(q, qs, ["qx", "qy"], ["qx", "qy"], "q", 3000)
    pairs = rows(minimap.rows_in_radius(q, qs, 3000), "q", "row_id", "d2")
    assert rows(got, "q", "row_id", "d2") == pairs == rows(cells, "q", "row_id", "d2") and len(pairs) > 5000
    side = 3000 / minimap.RADIUS_CELLS
    asked = {(r[0], r[1], r[2]) for r in got.select("q", F.floor(F.col("qx") / side), F.floor(F.col("qy") / side)).collect()}
    assert len(asked) * (side / 100 + 1) ** 2 < 2 * len(pairs)


def test_radius_queries_are_not_broadcast(spark, monkeypatch):
    """A query becomes a row per cell, so a small table of queries is not small there; sides and lanes of crowded cells lose and repeat nothing."""
    for name, n in (("SIDE_QUERIES", 3), ("LANE_POINTS", 20)):
        monkeypatch.setattr(gridsearch, name, n, raising=False)
    q = quantised(spark, 300)
    here = spark.range(90).selectExpr("id + 1000 as row_id", "30000L as qx", "30000L as qy")
    q = q.select("row_id", "qx", "qy").unionByName(here).unionByName(here.limit(5).withColumn("qx", F.lit(None).cast("long")))
    qs = spark.range(40).selectExpr("id as q", "29000 + (id % 10) * 300 as qx", "if(id = 39, null, 30000 + id) as qy")
    pts = [tuple(r) for r in q.collect() if r.qx is not None]
    d = lambda a, p: (a[1] - p[1]) ** 2 + (a[2] - p[2]) ** 2
    want = sorted((a.q, p[0], float(d(a, p))) for a in qs.collect() if a.qy is not None for p in pts if d(a, p) <= 3000**2)
    got = minimap.rows_in_radius(q, qs, 3000)
    assert len(want) >= 39 * 90 and rows(got, "q", "row_id", "d2") == want
    assert not [b for b in broadcasts(got) if "Generate" in b]


def test_capped_radius_lists_no_pairs(spark, monkeypatch):
    """Sides, lanes and flushes give what brute force gives, and no join of queries with rows is left."""
    for name, n in (("SIDE_QUERIES", 3), ("LANE_POINTS", 50), ("DISTANCES", 40), ("HITS", 30)):
        monkeypatch.setattr(discs, name, n)
    q = quantised(spark, 300)
    q = q.unionByName(q.withColumn("row_id", F.col("row_id") + 1000)).unionByName(q.limit(20).withColumn("qx", F.lit(None).cast("long")))
    pts = [(r.row_id, r.qx, r.qy) for r in q.collect() if r.qx is not None]
    asks = [(i, pts[i * 9][1] + i, pts[i * 9][2]) for i in range(12)] + [(50, -4000, 300), (51, 900000, 5)]
    qs = spark.createDataFrame(asks, "q long, qx long, qy long")
    d = lambda a, p: (a[1] - p[1]) ** 2 + (a[2] - p[2]) ** 2
    want = sorted((a[0], p[0], float(d(a, p))) for a in asks for p in sorted((p for p in pts if d(a, p) <= 9000**2), key=lambda p: (d(a, p), p[0]))[:5])
    got = minimap.rows_in_radius(q, qs, 9000, 5)
    assert rows(got, "q", "row_id", "d2") == want
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("counts", [30, 1 << 22])
def test_voxels_in_radius_are_counted_in_tasks(spark, monkeypatch, counts):
    for name, n in (("SIDE_QUERIES", 3), ("LANE_POINTS", 50), ("DISTANCES", 40), ("HITS", 30), ("COUNTS", counts)):
        monkeypatch.setattr(discs, name, n)
    q = quantised(spark, 300).select("row_id", "qx", "qy", (F.col("row_id") % 3).alias("chunk_id"), (F.col("row_id") % 5).alias("local_id"))
    q = q.unionByName(q.withColumn("row_id", F.col("row_id") + 1000))
    pts = q.collect()
    asks = [(i, pts[i * 9].qx + i, pts[i * 9].qy) for i in range(12)]
    qs = spark.createDataFrame(asks, "q long, qx long, qy long")
    want = []
    for i, x, y in asks:
        n = Counter((p.chunk_id, p.local_id) for p in pts if (p.qx - x) ** 2 + (p.qy - y) ** 2 <= 9000**2)
        want += [(i, *v, k, r) for r, (v, k) in enumerate(sorted(n.items(), key=lambda e: (-e[1], e[0])), 1)]
    got = minimap.voxels_in_radius(q, qs, 9000)
    assert rows(got, "q", "chunk_id", "local_id", "n", "rank") == sorted(want)
