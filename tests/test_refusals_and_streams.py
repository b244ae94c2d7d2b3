"""Refusals that stop a read, identities that travel with artifacts, fingerprints, folded receipts and streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.operators import inventory, metadata, ordering, vectors, voxels
from embedmap.sources import release, tables
from embedmap.streaming import ingest
from tests.conftest import rows


def test_conflicting_titles_stop_the_catalogue(spark):
    df = spark.createDataFrame([("1", "A", "x"), ("000000001", "A", "w"), ("2", "B", "y"), ("3", None, "z")], "id string, title string, author string")
    assert rows(tables.build_catalog(df), "id", "author") == [("000000001", "w"), ("000000002", "y"), ("000000003", "z")]
    clash = df.unionByName(spark.createDataFrame([("2", "C", "y")], df.schema))
    with pytest.raises(Exception, match="conflicting titles of book 000000002"):
        tables.build_catalog(clash).collect()
    assert tables.build_catalog(clash, "smallest").count() == 3
    with pytest.raises(ValueError):
        tables.build_catalog(df, "any")


def test_manifest_bytes_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "é", [1]), (None, 2.5, None, None)], "a long, b double, c string, d array<int>")
    row = release.digest(df).first()
    assert (row.n_rows, row.n_bytes) == (2, 8 + 2 + len('{"d":[1]}') + 8)
    # A value that moves to another column changes the digest.
    moved = spark.createDataFrame([(1, None), (None, 1)], "a long, b long")
    other = spark.createDataFrame([(1, None), (1, None)], "a long, b long")
    assert release.digest(moved).first().digest != release.digest(other).first().digest


def test_artifacts_of_another_map_are_refused(spark):
    points = spark.createDataFrame([(i, i % 3) for i in range(20)], "row_id long, v int")
    mine, other = (metadata.identity_of(release.release_manifest({"points": p})) for p in (points, points.filter("row_id < 19")))
    assert mine != other and mine.rows == 20
    matching = points.filter("v = 1").withColumns({"chunk_id": F.lit(0), "local_id": F.col("row_id") % 8})
    mask, counts = metadata.row_mask(matching), metadata.filter_counts(matching)
    good = metadata.check_snapshot(metadata.bind(mask, mine), metadata.bind(counts, mine), 20, 1, 2, mine).first()
    assert good.ok and good.bits == 7
    with pytest.raises(Exception, match="another map"):
        metadata.check_snapshot(metadata.bind(mask, mine), metadata.bind(counts, other), 20, 1, 2, mine).collect()
    with pytest.raises(ValueError):
        metadata.check_snapshot(mask, counts, 20, 1, 2, mine)
    with pytest.raises(ValueError):
        metadata.identity_of(release.release_manifest({"points": points}), "voxels")
    hits = spark.createDataFrame([(0, 1, 3, 0.5)], "q long, rank long, row_id long, score double")
    where, refs = points.select("row_id", F.lit(0).alias("chunk_id"), F.lit(0).alias("local_id")), points.select("row_id", F.col("row_id").alias("ref"), F.lit("s").alias("subset"))
    assert vectors.resolve_hits(metadata.bind(hits, mine), where, refs, mine).first().ref == 3
    with pytest.raises(Exception, match="another map"):
        vectors.resolve_hits(metadata.bind(hits, other), where, refs, mine).collect()
    assert rows(metadata.foreign_rows({"a": metadata.bind(counts, mine), "b": metadata.bind(counts, other)}, mine), "artifact", "n_foreign") == [("a", 0), ("b", counts.count())]


def test_fingerprints_find_every_difference(spark):
    a = spark.createDataFrame([(1, None), (None, 1), (2, 2), (2, 2), (3, 3)], "x long, y long")
    b = spark.createDataFrame([(1, None), (1, None), (2, 2), (4, 4), (3, 3)], "x long, y long")
    got = sorted((r.side, r.x, r.y) for r in voxels.table_difference(a, b).collect() if r.x is not None)
    assert got == [("left", 2, 2), ("right", 1, None), ("right", 4, 4)]
    assert voxels.table_difference(a, b).count() == 4 and voxels.differing_buckets(a, b).count() == 4
    assert voxels.table_difference(a, a.repartition(3)).isEmpty() and voxels.differing_buckets(a, a.repartition(3)).isEmpty()
    assert voxels.compare_proxy(a, b.limit(0)).first().asDict() == {"n_stored": 5, "n_derived": 0, "n_only_stored": 5, "n_only_derived": 0}


def test_percentiles_of_groups(spark):
    """A hot group, ties, one value, nulls as group and value; bins of one value and of many."""
    rng = np.random.default_rng(1)
    data = [("hot", float(x)) for x in rng.normal(size=4000)] + [("ties", float(x)) for x in rng.integers(0, 3, 500)] + [("one", 2.5), (None, 1.0), (None, 2.0), ("one", None)]
    df = spark.createDataFrame(data, "g string, v double")
    ps = [0.0, 0.001, 0.25, 0.5, 0.95, 1.0]
    got = {(r.g, r.p): r.value for r in ordering.exact_percentiles(df, ["g"], ["v"], ps).collect()}
    for g in ("hot", "ties", "one", None):
        values = [v for k, v in data if k == g and v is not None]
        for p in ps:
            assert got[g, p] == pytest.approx(np.quantile(values, p), rel=1e-12), (g, p)
    assert len(got) == 4 * len(ps)


def test_a_batch_reads_what_it_can_take(spark):
    """Postings behind the reach of every cursor are left out by the scan, and others by each voxel's bounds, before a shuffle."""
    postings = spark.createDataFrame([(c, 0, 1000 * c + i, i) for c in range(3) for i in range(500)], "chunk_id long, local_id long, row_id long, pos long")
    stacks = spark.createDataFrame([(1, 0, 40)], "chunk_id long, local_id long, cursor long")
    held = spark.createDataFrame([(1, 0, 1000 + i, "held", i >= 40, i) for i in range(46)] + [(1, 0, 1003, "returned", False, 99)],
                                 "chunk_id long, local_id long, row_id long, state string, selected boolean, seq long")
    bounds = inventory.batch_bounds(held, stacks, 5)
    assert rows(bounds, "low", "high") == [(40, 51)]
    got = rows(inventory.next_batch(postings, held, stacks, 5), "chunk_id", "row_id", "take")
    assert got == [(0, i, i + 1) for i in range(5)] + [(1, 1003, 1), (1, 1046, 2), (1, 1047, 3), (1, 1048, 4), (1, 1049, 5)] + [(2, 2000 + i, i + 1) for i in range(5)]
    plan = inventory.next_batch(postings, held, stacks, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "(pos#" in plan and "< 51" in plan


def test_receipts_are_folded(spark, scratch):
    schema = "shard string, v long"
    for drop in range(3):
        spark.createDataFrame([(f"s{drop % 2}", 10 * drop + i) for i in range(4)], schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        ingest.ingest_shards_stream(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/log", schema).awaitTermination()
        if drop == 1:
            assert ingest.fold_receipts(spark, f"{scratch}/out") == 1
    known = ingest.receipts(spark, f"{scratch}/out")
    assert rows(known, "batch", "n_rows") == [(0, 4), (1, 4), (2, 4)] and ingest.read_ingested(spark, f"{scratch}/out").count() == 12
    assert ingest.fold_receipts(spark, f"{scratch}/out") == 2
    assert rows(ingest.receipts(spark, f"{scratch}/out"), "batch") == [(0,), (1,), (2,)]
    # Rows of a batch without a receipt do not exist.
    spark.createDataFrame([("x", 1)], schema).write.parquet(f"{scratch}/out/rows/batch=7")
    assert ingest.read_ingested(spark, f"{scratch}/out").count() == 12
    assert ingest.fold_receipts(spark, f"{scratch}/nothing") is None


def test_usage_stream_is_resumed_and_late_rows_left_out(spark, scratch):
    start = datetime(2024, 1, 1)
    schema = "at timestamp, metric string, value double"

    def drop(name, rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        return ingest.stored_usage_stream(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/log", schema, ["metric"], "2 hours")

    first = drop("a", [(start + timedelta(minutes=20 * i), "m", 1.0) for i in range(30)])
    assert first.agg(F.sum("n")).first()[0] == 30
    more = drop("b", [(start + timedelta(hours=9, minutes=50), "m", 5.0), (start + timedelta(hours=30), "m", 1.0)])
    assert {r.hour.hour: (r.value, r.n) for r in more.collect()}[9] == (8.0, 4)
    late = drop("c", [(start + timedelta(hours=1), "m", 100.0), (start + timedelta(hours=29), "m", 7.0)])
    got = {r.hour: (r.value, r.n) for r in late.collect()}
    assert got[start + timedelta(hours=1)] == (3.0, 3) and got[start + timedelta(hours=29)] == (7.0, 1)
