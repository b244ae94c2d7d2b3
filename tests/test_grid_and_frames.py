from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embedmap.functions import codec, grid
from embedmap.operators import frames
from embedmap.operators.ordering import (
    dense_row_id, exact_percentiles, id_bucket, limit_per_group, md5_bucket, md5_priority, position_in_order, rank_in_group, running_total,
)
from tests.conftest import rows


def test_bins_clip_into_edge_cells(spark):
    df = spark.createDataFrame([(-1.0,), (-1.5,), (0.0,), (0.999,), (1.0,), (7.0,)], "c double")
    assert [r[0] for r in df.select(grid.bin_axis(F.col("c"), 4)).collect()] == [0, 0, 2, 3, 3, 3]


def test_index_is_row_major_x_fastest_and_inverts(spark):
    df = spark.range(8**3).select("id", *[a.alias(n) for a, n in zip(grid.axes_of(F.col("id"), 8), "xyz")])
    back = df.withColumn("back", grid.flat_index(F.col("x"), F.col("y"), F.col("z"), 8))
    assert back.filter("back <> id").count() == 0
    assert rows(df.filter("id = 1"))[0] == (1, 1, 0, 0)


def test_chunk_and_local_recover_the_voxel(spark):
    df = spark.range(12**3).select(*[a.alias(n) for a, n in zip(grid.axes_of(F.col("id"), 12), ("vx", "vy", "vz"))])
    out = frames.address(df, 12, 3)
    axes = grid.voxel_axes(F.col("chunk_id"), F.col("local_id"), 12, 3)
    wrong = out.filter((axes[0] != F.col("vx")) | (axes[1] != F.col("vy")) | (axes[2] != F.col("vz")))
    assert wrong.count() == 0
    with pytest.raises(ValueError):
        grid.require_divisible(10, 4)


def test_morton_matches_bit_interleaving(spark):
    def interleave(x, y):
        return sum(((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1) for i in range(8))

    pairs = [(0, 0), (1, 0), (0, 1), (255, 255), (170, 85), (13, 200)]
    df = spark.createDataFrame(pairs, "x long, y long")
    assert [r[0] for r in df.select(grid.morton(F.col("x"), F.col("y"))).collect()] == [interleave(*p) for p in pairs]


def test_compact_side_is_smallest_power_of_two(spark):
    for r in spark.range(1, 300).select("id", grid.compact_side(F.col("id")).alias("s")).collect():
        assert r.s**2 >= r.id and (r.s == 1 or (r.s // 2) ** 2 < r.id) and r.s & (r.s - 1) == 0


def test_max_zoom():
    assert [grid.choose_max_zoom(n) for n in (1, 65536, 65537, 10**6, 10**7, 10**12)] == [0, 0, 1, 2, 4, 5]


def test_codecs_round_trip_and_bounds(spark):
    df = spark.createDataFrame([(0, 0), (65535, 65535), (7, 12)], "a long, b long")
    ref = df.select("a", "b", codec.pack_ref(F.col("a"), F.col("b")).alias("r"))
    s, l = codec.unpack_ref(F.col("r"))
    assert ref.filter((s != F.col("a")) | (l != F.col("b"))).count() == 0
    assert df.select(codec.ref_in_range(F.col("a"), F.col("b") + 1)).collect()[1][0] is False
    p = spark.createDataFrame([(15, 2**28 - 1)], "c long, r long").select(codec.pack_point(F.col("c"), F.col("r")).alias("p"))
    assert p.first()[0] == 2**32 - 1
    assert p.select(*codec.unpack_point(F.col("p"))).first()[:] == (15, 2**28 - 1)


def test_frame_ignores_outliers_and_pads_flat_axes(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(4000, 3))
    pts[0], pts[1] = 1000, -1000
    pts[:, 2] = 5.0
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "row_id long, x double, y double, z double")
    f = frames.compute_frame_3d(df)
    spans = [b - a for a, b in zip(f.extent[::2], f.extent[1::2])]
    assert max(spans) - min(spans) < 1e-9 and max(spans) < 10
    assert f.raw_extent[4:] == [4.0, 6.0]  # zero span pads by one
    lo, hi = np.percentile(pts[:, 0], [0.1, 99.9])
    assert np.isclose(f.raw_extent[0], lo - 0.02 * (hi - lo))


def test_exact_percentiles_equal_numpy_even_with_a_dominant_value(spark):
    rng = np.random.default_rng(3)
    data = [("a", float(v)) for v in rng.normal(size=5000)] + [("b", 1.0)] * 4000 + [("b", float(v)) for v in rng.random(2000)] + [("c", 2.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {(r.g, r.p): r.value for r in exact_percentiles(df, ["g"], ["v"], [0.0, 0.001, 0.3, 0.5, 0.995, 1.0]).collect()}
    for g in "abc":
        for p in (0.0, 0.001, 0.3, 0.5, 0.995, 1.0):
            assert np.isclose(got[g, p], np.percentile([v for k, v in data if k == g], p * 100), atol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), st.floats(0, 1))
def test_exact_percentiles_on_tiny_groups(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_percentiles(df, [], ["v"], [p]).first().value
    assert np.isclose(got, np.percentile(values, p * 100), rtol=1e-9, atol=1e-9)


def test_rank_selection_equals_numpy(spark, monkeypatch):
    """The scalar percentiles of frames, with few bins so that several rounds run, and one value on a third of the rows."""
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])
    b = np.exp(rng.normal(size=6000) * 4)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double").repartition(5)
    monkeypatch.setattr(frames, "HISTOGRAM_BINS", 8)
    monkeypatch.setattr(frames, "LIST_ROWS", 20)
    ps = [0.0, 0.001, 0.37, 0.5, 0.999, 1.0]
    got = frames.percentiles(df, ["a", "b"], ps)
    for c, v in (("a", a), ("b", b)):
        assert np.allclose(got[c], np.percentile(v, [p * 100 for p in ps]), rtol=1e-12)


def test_linspace_sample_equals_the_formula(spark):
    for n, k in ((100, 7), (1000, 999), (5, 9), (17, 1)):
        df = spark.range(n).withColumnRenamed("id", "row_id")
        want = sorted({i * (n - 1) // (k - 1) for i in range(k)}) if 1 < k < n else list(range(n)) if k >= n else [0]
        assert [r[0] for r in rows(frames.linspace_sample(df, n, k))] == want


@pytest.mark.parametrize("hot", [1, 50, 10**9])
def test_ranks_do_not_depend_on_splitting_or_layout(spark, hot):
    """One group holds most rows; every split must give the plain rank."""
    data = [(0 if i % 10 else i % 7 + 1, i) for i in range(2000)]
    df = spark.createDataFrame(data, "g long, i long").repartition(5)
    got = rank_in_group(df, ["g"], ["i"], "r", id_bucket("i", 4), hot)
    seen: dict[int, int] = {}
    want = []
    for g, i in data:
        want.append((g, i, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert rows(got, "g", "i", "r") == sorted(want)


def test_ranks_by_hash_priority_split_hot_groups(spark):
    df = spark.range(3000).withColumnRenamed("id", "row_id").withColumn("p", md5_priority(1, "row_id")).withColumn("g", F.lit(0))
    split = rank_in_group(df, ["g"], ["p", "row_id"], "r", md5_bucket("p"), 10)
    order = [r.row_id for r in split.orderBy("r").collect()]
    assert order == [r.row_id for r in df.orderBy("p", "row_id").collect()]


def test_running_total_over_the_whole_table(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 13).repartition(6)
    got = [r.t for r in running_total(df, [], ["id"], F.col("v"), "t", id_bucket("id", 5)).orderBy("id").collect()]
    values = [(i * 7919) % 13 for i in range(1000)]
    assert got == [sum(values[:i]) for i in range(1000)]


def test_position_matches_a_global_sort(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") * 31 % 5).alias("t"), (F.col("id") * 17 % 3).alias("m"))
    df = df.withColumn("t", F.when(F.col("row_id") % 3 == 0, 2).otherwise(F.col("t")))
    got = position_in_order(df.repartition(7), ["t"], ["m"], "row_id", "pos", id_bucket("row_id", 6), 100)
    want = [(r.row_id, i) for i, r in enumerate(df.orderBy("t", "m", "row_id").collect())]
    assert rows(got, "row_id", "pos") == sorted(want)


def test_dense_row_id_is_layout_independent(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    for parts in (1, 7):
        got = dense_row_id(df.repartition(parts), ["k"])
        assert rows(got, "k", "row_id") == [(i, i) for i in range(500)]


def test_limit_per_group_prunes_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    out = limit_per_group(df, ["g"], ["id"], 3)
    assert rows(out, "g", "id", "rank") == [(0, 0, 1), (0, 2, 2), (0, 4, 3), (1, 1, 1), (1, 3, 2), (1, 5, 3)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf")])
def test_frames_refuse_what_is_not_finite(spark, bad):
    df = spark.range(30_000).select("id", (F.col("id") * 1.0).alias("x"), F.when(F.col("id") == 7, F.lit(bad)).otherwise(F.col("id") * 2.0).alias("y"), F.lit(1.0).alias("z"))
    for call in (frames.compute_frame_3d, frames.compute_frame_2d, lambda d: frames.robust_extent(d, ["y"])):
        with pytest.raises(ValueError, match="NaN or infinite"):
            call(df)
    with pytest.raises(ValueError, match="no values"):
        frames.compute_frame_3d(df.limit(0))


def test_packed_keys_refuse_what_does_not_fit(spark):
    one = lambda *v: spark.createDataFrame([v], "a long, b long")
    for pack, fits, not_ in ((codec.pack_point, (15, 2**28 - 1), (0, 2**28)), (codec.pack_voxel, (2**20 - 1, 4095), (0, 4096)), (codec.pack_ref, (65535, 65535), (1, 65536))):
        assert one(*fits).select(pack(F.col("a"), F.col("b"))).first()[0] is not None
        assert one(None, 1).select(pack(F.col("a"), F.col("b"))).first()[0] is None
        with pytest.raises(Exception, match="out of range"):
            one(*not_).select(pack(F.col("a"), F.col("b"))).collect()


def test_high_field_of_a_packed_reference_is_not_bounded_by_32_bits(spark):
    df = spark.createDataFrame([(65536, 3), (89999, 65535), (2**47 - 1, 65535)], "a long, b long")
    back = df.select("a", "b", codec.pack_ref(F.col("a"), F.col("b")).alias("p")).select("a", "b", "p", *codec.unpack_ref(F.col("p")))
    assert [tuple(r) for r in back.collect()] == [(a, b, a * 2**16 + b, a, b) for a, b in [(65536, 3), (89999, 65535), (2**47 - 1, 65535)]]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(2**47, 0)], "a long, b long").select(codec.pack_ref(F.col("a"), F.col("b"))).collect()


def test_high_field_of_a_packed_voxel_is_not_bounded_by_32_bits(spark):
    df = spark.createDataFrame([(2**20, 4095), (2**51 - 1, 4095)], "a long, b long")
    back = df.select("a", "b", codec.pack_voxel(F.col("a"), F.col("b")).alias("p")).select("p", *codec.unpack_voxel(F.col("p")))
    assert [tuple(r) for r in back.collect()] == [(2**32 + 4095, 2**20, 4095), (2**63 - 1, 2**51 - 1, 4095)]
