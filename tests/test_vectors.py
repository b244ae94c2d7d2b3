from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.operators import ann, blocks, vectors
from tests.conftest import rows

rng = np.random.default_rng(42)
X = rng.normal(size=(400, 32))
X /= np.linalg.norm(X, axis=1, keepdims=True)


def frame(spark, m, name="row_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<double>")


@pytest.fixture(scope="module")
def base(spark):
    return frame(spark, X).repartition(5).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return frame(spark, X[[13, 99, 200]] + 0.01, "q").cache()


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_exact_search_equals_numpy(base, queries, metric):
    got = {}
    for r in vectors.knn_exact(base, queries, 10, metric).collect():
        got.setdefault(r.q, []).append((r.rank, r.row_id, r.score))
    for q, v in enumerate(X[[13, 99, 200]] + 0.01):
        s = {"ip": X @ v, "cosine": X @ v / np.linalg.norm(v), "l2": -((X - v) ** 2).sum(axis=1)}[metric]
        want = np.lexsort((np.arange(400), -np.round(s, 6)))[:10]
        found = sorted(got[q])
        assert [f[1] for f in found] == want.tolist() and np.allclose([f[2] for f in found], s[want], atol=1e-6)


def test_ties_take_the_lowest_row_in_every_layout(spark):
    same = frame(spark, np.ones((50, 4)))
    q = frame(spark, np.ones((1, 4)), "q")
    for parts in (1, 7):
        assert rows(vectors.knn_exact(same.repartition(parts), q, 3), "row_id") == [(0,), (1,), (2,)]


def test_query_and_data_blocks_are_bounded(base, queries, monkeypatch):
    """Small blocks, broadcast or on the grid, give the same result; the grid has no broadcast and no row on the driver."""
    whole = rows(vectors.knn_exact(base, queries, 5))
    monkeypatch.setattr(blocks, "QUERY_VALUES", 32)
    monkeypatch.setattr(blocks, "DATA_VALUES", 320)
    assert vectors.query_blocks(queries).count() == 3 and vectors.vector_blocks(base).count() >= 40
    assert rows(vectors.knn_exact(base, queries, 5)) == whole
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(blocks, "SIDE_BLOCKS", 2)
    grid = vectors.knn_exact(base, queries, 5)
    assert rows(grid) == whole
    model = ann.ivf_train(base, 6, seed=1)
    index = ann.ivf_assign(base, model)
    assert rows(ann.ivf_search(index, model, queries, 10, 6), "q", "row_id") == rows(vectors.knn_exact(base, queries, 10), "q", "row_id")


def test_blocks_can_be_stored(spark, base, queries, scratch):
    blocks.write(vectors.vector_blocks(base), f"{scratch}/blocks")
    stored = spark.read.parquet(f"{scratch}/blocks")
    assert rows(vectors.knn_blocks(stored, queries, 5, kind="<f8")) == rows(vectors.knn_exact(base, queries, 5))


def test_no_queries_and_no_rows(spark, base, queries):
    assert vectors.knn_exact(base, queries.limit(0), 5).count() == vectors.knn_exact(base.limit(0), queries, 5).count() == 0


def test_lists_of_codes(spark, base, queries, scratch):
    """Codes of all lists find nearly what the exact search finds, and exactly that once rescored; one list reads its own row groups."""
    model = ann.train_codes(base, ann.ivf_train(base, 8, seed=1))
    ann.write_lists(ann.code_blocks(base, model), f"{scratch}/lists")
    stored = ann.read_lists(spark, f"{scratch}/lists")
    assert stored.agg(F.sum(F.length("ids"))).first()[0] == 8 * 400 and stored.select("key").distinct().count() == 8
    exact = vectors.knn_exact(base, queries, 10)
    found = ann.search_lists(stored, model, queries, 40, 8)
    assert vectors.recall_at_k(found, exact, 10).first().recall >= 0.9
    assert rows(ann.refine(found, base, queries, 10), "q", "row_id") == rows(exact, "q", "row_id")
    scored = {(r.q, r.row_id): r.score for r in found.collect()}
    for r in ann.refine(found, base, queries, 40).collect():
        assert abs(scored[r.q, r.row_id] - r.score) < 0.02
    plan = ann.search_lists(stored, model, queries.filter("q = 0"), 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(key" in plan or "PushedFilters: [In(key" in plan or "EqualTo(key" in plan


def test_zero_and_nan_vectors_are_refused(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, [3.0, 4.0])], "row_id long, embedding array<double>")
    assert rows(vectors.invalid_vectors(df), "row_id") == [(0,), (1,)]
    assert vectors.l2_normalize(df.filter("row_id = 2")).first().embedding == [0.6, 0.8]
    with pytest.raises(Exception, match="non-finite"):
        vectors.l2_normalize(df).collect()


def test_all_lists_equal_exact_and_fewer_lists_lose_little(spark, base, queries):
    model = ann.ivf_train(base, 20, seed=1)
    assert len(model.centroids) == 20
    with pytest.raises(Exception):
        ann.ivf_train(base.limit(3), 9)
    index = ann.ivf_assign(base, model).cache()
    assert rows(index, "row_id") == [(i,) for i in range(400)]
    exact = vectors.knn_exact(base.withColumn("embedding", F.col("embedding").cast("array<float>")), queries, 10)
    assert rows(ann.ivf_search(index, model, queries, 10, 99)) == rows(exact)
    half = ann.ivf_search(index, model, queries, 10, 10)
    assert vectors.recall_at_k(half, exact, 10).first().recall > 0.5


def test_index_is_stored_by_list(spark, base, scratch):
    model = ann.ivf_train(base, 4, seed=1)
    index = ann.ivf_assign(base, model)
    ann.write_ivf(index, f"{scratch}/ivf")
    stored, q = ann.read_ivf(spark, f"{scratch}/ivf"), frame(spark, X[[7]], "q")
    assert stored.count() == 400
    found = ann.ivf_search(stored, model, q, 5, 1)
    assert rows(found) == rows(ann.ivf_search(index, model, q, 5, 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(list_id" in plan or "PushedFilters: [In(list_id" in plan or "EqualTo(list_id" in plan


def test_product_codes_and_refinement(base, queries):
    books = ann.pq_train(base, 8, 100, seed=1)
    assert books.shape == (8, 100, 4)
    with pytest.raises(ValueError):
        ann.pq_train(base, 8, 257)
    coded = ann.pq_encode(base, books)
    assert coded.first().codes.__len__() == 8
    candidates = ann.pq_search(coded, books, queries, 80)
    exact = vectors.knn_exact(base, queries, 10)
    refined = ann.refine(candidates, base, queries, 10)
    before, after = (vectors.recall_at_k(df, exact, 10).first().recall for df in (candidates, refined))
    assert after >= before and after > 0.8


def test_quantised_codes_decode_within_a_step(base):
    ranges = vectors.sq8_train(base)
    decoded = vectors.sq8_decode(vectors.sq8_encode(base, ranges), ranges).collect()
    step = (X.max(axis=0) - X.min(axis=0)) / 255
    for r in decoded:
        assert (np.abs(np.array(r.embedding) - X[r.row_id]) <= step + 1e-12).all()
    coded = vectors.int8_encode(base).collect()
    for r in coded:
        assert np.array_equal(r.codes, np.clip(np.rint(X[r.row_id] / (np.abs(X[r.row_id]).max() / 127)), -127, 127))


def test_projections(base):
    mean, comp = X.mean(axis=0), rng.normal(size=(32, 3))
    want = (X - mean) @ comp
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    for r in vectors.project_affine(base, mean, comp).collect():
        assert np.allclose(r.projected, want[r.row_id])
    w1, w2 = rng.normal(size=(32, 8)), rng.normal(size=(8, 2))
    head = np.maximum(X @ w1 + 0.1, 0) @ w2
    layers = [(w1, [0.1] * 8), (w2, [0.0] * 2)]
    out = vectors.project_head(base, layers, ["x", "y"])
    assert all(np.allclose((r.x, r.y), head[r.row_id]) for r in out.collect())
    assert vectors.projection_error(out, out, ["x", "y"]).first().ok
    assert not vectors.projection_error(out, out.withColumn("x", F.col("x") + 0.01), ["x", "y"]).first().ok
    with pytest.raises(Exception, match="non-finite"):
        vectors.project_head(base, [(w1 * np.inf, [0.0] * 8)], list("abcdefgh")).collect()


def test_null_and_ragged_vectors_are_refused(spark):
    schema = "row_id long, embedding array<double>"
    for broken in ([(0, [1.0, 2.0]), (1, None)], [(0, [1.0, None]), (1, [1.0, 2.0])], [(0, [1.0, 2.0, 3.0]), (1, [1.0])]):
        df = spark.createDataFrame(broken, schema).coalesce(1)
        for op in (vectors.int8_encode, vectors.sq8_train, vectors.l2_normalize):
            with pytest.raises(Exception, match="null vector|different lengths"):
                op(df).collect()
    empty = spark.createDataFrame([], schema)
    assert vectors.project_affine(empty, [0.0], [[1.0]]).count() == vectors.int8_encode(empty).count() == 0


def test_many_queries_are_scored_in_slices(base, queries, monkeypatch):
    whole = rows(vectors.knn_exact(base, queries, 5))
    monkeypatch.setattr(blocks, "SCORE_VALUES", 7)
    monkeypatch.setattr(blocks, "KEPT_ROWS", 1)
    assert rows(vectors.knn_exact(base, queries, 5)) == whole


def test_projection_of_the_mean_is_refused(spark):
    with pytest.raises(Exception, match="cannot be normalised"):
        vectors.project_affine(frame(spark, np.ones((1, 2))), [1.0, 1.0], np.eye(2)).collect()


def test_codes_of_all_lists_are_rescored_as_far_as_they_err(spark, scratch):
    """Rows closer together than a step of the codes: four times as many by codes miss some, the bar of the error does not."""
    near = np.random.default_rng(3).normal(size=(1200, 8)) * 0.01 + 1.0
    base = frame(spark, np.concatenate([near, np.eye(8) * 40.0, -np.eye(8) * 40.0])).repartition(3).cache()
    q = frame(spark, np.array([[0.3] * 8, [0.1] * 4 + [0.2] * 4]), "q")
    model = ann.train_codes(base, ann.ivf_train(base, 2, seed=1))
    ann.write_lists(ann.code_blocks(base, model), f"{scratch}/lists")
    stored = ann.read_lists(spark, f"{scratch}/lists")
    want = rows(vectors.knn_exact(base, q, 10), "q", "row_id", "score", "rank")
    assert rows(ann.refine(ann.search_lists(stored, model, q, 40, 2), base, q, 10), "q", "row_id", "score", "rank") != want
    assert rows(ann.search_lists_exact(stored, model, base, q, 10), "q", "row_id", "score", "rank") == want
    assert ann.search_lists_exact(stored, model, base, q, 5000).count() == 2 * 1216


def test_sides_of_the_grid_hold_a_bounded_number_of_best_rows(spark, monkeypatch):
    """Queries times k bound what a cell of the grid keeps, whatever the number of queries."""
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(blocks, "QUERY_VALUES", 32 * 4)
    monkeypatch.setattr(blocks, "KEPT_ROWS", 40)
    base, q = frame(spark, X).repartition(3), frame(spark, X[:40] + 0.01, "q").coalesce(1)
    asked = vectors.query_blocks(q).cache()
    assert asked.count() == 10
    assert [r.sides for r in blocks.sides_of(asked, 10).collect()] == [10] and [r.sides for r in blocks.sides_of(asked, 3).collect()] == [3]
    got = blocks.nearest(vectors.vector_blocks(base), asked, 10, lambda key, q, x: vectors.scores("ip", x.astype(np.float64), q), "<f8", lanes=2)
    assert rows(got) == rows(vectors.knn_exact(base, q, 10))


def test_copies_of_a_query_follow_the_data_and_not_the_partitions(spark, base, queries, monkeypatch):
    """On the grid a query meets as many lanes as its data fill, so its copies and best rows don't grow with the shuffle partitions."""
    whole = rows(vectors.knn_exact(base, queries, 5))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(blocks, "DATA_VALUES", 160)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert vectors.vector_blocks(base).count() >= 80
        assert rows(vectors.knn_exact(base, queries, 5)) == whole
        monkeypatch.setattr(blocks, "limit_per_group", lambda hits, *a: hits)
        assert vectors.knn_exact(base, queries, 5).count() <= 3 * 5 * 3 * spark.sparkContext.defaultParallelism  # queries, k, cells per core
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_crowded_keys_have_more_lanes(spark, base, queries, monkeypatch):
    keyed = base.select("row_id", "embedding", F.when(F.col("row_id") < 300, 1).otherwise(F.col("row_id") % 4 + 2).alias("list_id"))
    data = blocks.pack(keyed, vectors.matrix, 320, "list_id").cache()
    asked = blocks.pack(queries.crossJoin(spark.range(7).withColumnRenamed("id", "list_id")), vectors.matrix, blocks.QUERY_VALUES, "list_id").cache()
    held = {r.key: r for r in blocks.cells_of(data, asked, 5).collect()}
    assert set(held) == {1, 2, 3, 4, 5} and held[1].lanes > 2 * max(held[k].lanes for k in (2, 3, 4, 5))
    monkeypatch.setattr(blocks, "LANE_BYTES", 1)
    assert {r.key: r.lanes for r in blocks.cells_of(data, asked, 5).collect()} == {r.key: r.n for r in data.groupBy("key").agg(F.count("ids").alias("n")).collect()}
    assert blocks.cells_of(data.limit(0), asked, 5).count() == 0
