from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from embedmap.operators import blobs, metrics
from embedmap.operators.keys import ContractError
from embedmap.sources import release, tables
from embedmap.streaming import ingest
from tests.conftest import rows


def points(spark, n=12):
    return spark.range(n).select(F.col("id").alias("row_id"), F.lit("a").alias("subset"), (F.col("id") * 7 % 11).alias("global_idx"))


CONTRACT = ["row_id", "subset", "global_idx"]


def test_rebuild_contract(spark, scratch):
    release.write_points_table(points(spark), scratch, "r1", CONTRACT)
    more = points(spark).withColumn("fname", F.lit("x")).withColumn("global_idx", F.col("global_idx").cast("int"))
    release.write_points_table(more, scratch, "r2", CONTRACT)
    assert release.current_release(spark, scratch) == "r2"
    bad = {
        "reordered": points(spark).withColumn("global_idx", F.lit(11) - F.col("global_idx")),
        "short": points(spark, 11),
        "one cell": points(spark).withColumn("subset", F.when(F.col("row_id") == 5, "b").otherwise("a")),
        "no column": points(spark).drop("subset"),
    }
    for name, df in bad.items():
        with pytest.raises(ContractError):
            release.write_points_table(df, scratch, f"bad {name}", CONTRACT)
        assert release.current_release(spark, scratch) == "r2"
    assert "fname" in release.read_release(spark, scratch, "r2")["points"].columns
    diff = {r["column"]: (r["n_differing"], r["first_row"]) for r in release.contract_diff(bad["one cell"], points(spark), CONTRACT).collect()}
    assert diff == {"row_id": (0, None), "subset": (1, 5), "global_idx": (0, None)}


def test_failed_build_leaves_the_release(spark, scratch):
    ok = lambda t: None
    release.publish_release(lambda: {"t": spark.range(5)}, ok, scratch, "one")

    def refuse(t):
        raise ContractError("no")

    with pytest.raises(ContractError):
        release.publish_release(lambda: {"t": spark.range(9)}, refuse, scratch, "two")
    assert release.releases(spark, scratch) == [(0, "one")]
    with pytest.raises(FileExistsError):
        release.publish_release(lambda: {"t": spark.range(9)}, ok, scratch, "one")
    assert release.read_release(spark, scratch, "one")["t"].count() == 5
    release.publish_release(lambda: {"t": spark.range(9)}, ok, scratch, "two")
    assert release.releases(spark, scratch) == [(0, "one"), (1, "two")]
    manifest = release.read_manifest(spark, scratch, "two")
    assert release.validate_release(manifest, release.read_release(spark, scratch, "two")).isEmpty()
    changed = {"t": spark.range(9).withColumn("id", F.when(F.col("id") == 3, 30).otherwise(F.col("id")))}
    assert rows(release.validate_release(manifest, changed)) == [("t", "digest")]  # a value of the same width
    assert rows(release.validate_release(manifest, {"t": spark.range(9).select(F.col("id").cast("int"))})) == [("t", "bytes"), ("t", "digest")]


def test_digest_ignores_order_not_content(spark):
    a, b = release.digest(spark.range(100)).first(), release.digest(spark.range(100).orderBy(F.desc("id")).repartition(7)).first()
    assert a == b and a != release.digest(spark.range(99).union(spark.range(1))).first()


def test_catalogue_and_harvest(spark, scratch):
    with open(f"{scratch}/c.tsv", "w") as f:
        f.write("book_identifier\ttitle\tfirst_author\tpublisher\tpubplace\tARK_id_of_book\n12\tT\tA\tP\tL\tx\n000000012\tT\tB\tP\tL\tx\n7\tU\tA\tP\tL\ty\n7\tV\tA\tP\tL\ty\n")
    raw = tables.read_catalog(spark, f"{scratch}/c.tsv")
    assert rows(tables.build_catalog(raw, "smallest"), "id", "title", "author") == [("000000007", "U", "A"), ("000000012", "T", "A")]
    with pytest.raises(Exception, match="conflicting titles of book 000000007"):
        tables.build_catalog(raw).collect()
    assert rows(tables.catalog_conflicts(raw), "id") == [("000000007",)]
    shard = spark.createDataFrame([("", float("nan")), ("u", 70000.0), (None, -3.0), ("v", float("inf")), ("w", 12.7)], "url string, width double")
    assert rows(tables.harvest_columns(shard).na.fill("-"), "url", "width", "height") == [("-", 0, 0), ("-", 0, 0), ("u", 65535, 0), ("v", 0, 0), ("w", 12, 0)]
    assert rows(tables.harvest_columns(spark.range(1)), "width", "height") == [(0, 0)]


def test_manifest_set_refuses_an_empty_subset(spark, scratch):
    spark.range(3).write.parquet(f"{scratch}/a")
    spark.range(2).write.parquet(f"{scratch}/b")
    both = tables.read_manifest_set(spark, {"a": f"{scratch}/a", "b": f"{scratch}/b"})
    assert rows(both.groupBy("subset").count()) == [("a", 3), ("b", 2)]
    with pytest.raises(FileNotFoundError):
        tables.read_manifest_set(spark, {"a": f"{scratch}/a", "c": f"{scratch}/none"})
    with pytest.raises(ValueError):
        tables.read_points(spark, f"{scratch}/a", ["id", "zz"])


def test_offsets_and_spans(spark):
    data = spark.createDataFrame([(0, 0, 5), (0, 1, None), (0, 2, 3), (1, 0, 7)], "shard long, local long, n_bytes long")
    offsets = blobs.pack_offsets(data)
    assert rows(offsets) == [(0, 0, 0, 5), (0, 1, 5, 5), (0, 2, 5, 8), (1, 0, 0, 7)]
    declared = blobs.shard_manifest(offsets).select("shard", "n_rows", "n_bytes")
    assert blobs.check_offsets(offsets, declared).isEmpty()
    gap = offsets.withColumn("start", F.when(F.col("local") == 2, 6).otherwise(F.col("start")))
    assert rows(blobs.check_offsets(gap, declared)) == [(0, "not contiguous")]
    assert rows(blobs.check_offsets(offsets.filter("shard = 0"), declared)) == [(1, "missing shard")]
    assert rows(blobs.check_offsets(offsets, declared, 4)) == [(0, "span too large"), (1, "span too large")]
    refs = spark.createDataFrame([(0,), (1,), (2,), (65536,), (99999999,)], "ref long")
    assert [r[1:] for r in rows(blobs.lookup_spans(offsets, refs))] == [(0, 5), (5, 0), (5, 3), (0, 7), (0, 0)]


def test_address_beside_a_reference_decides(spark):
    offsets = blobs.pack_offsets(spark.createDataFrame([(0, 2, 3), (1, 0, 7)], "shard long, local long, n_bytes long"))
    refs = spark.createDataFrame([(65536, 0, 65536), (65536, 1, 0), (2, 0, 2)], "ref long, shard long, local long")
    assert rows(blobs.lookup_spans(offsets, refs)) == [(2, 0, 3), (65536, 0, 0), (65536, 0, 7)]


def test_url_sidecar(spark):
    pts = spark.createDataFrame([(0, "ab", 5, -1), (1, None, 70000, 2), (2, "", 1, 1), (3, "é", 1, 1)], "row_id long, url string, width long, height long")
    for bits in (1, 20):
        meta = blobs.encode_urls(pts, split_bits=bits)
        assert rows(meta, "row_id", "url_offset", "url_len", "width", "height") == [(0, 0, 2, 5, 0), (1, 2, 0, 65535, 2), (2, 2, 0, 1, 1), (3, 2, 2, 1, 1)]
    assert blobs.meta_summary(meta).first()[:] == (4, 2, 4)
    look = blobs.lookup_meta(meta, spark.createDataFrame([(2,), (9,)], "row_id long"), 4)
    assert rows(look.na.fill("-"), "row_id", "url", "in_range") == [(2, "-", True), (9, "-", False)]
    with pytest.raises(Exception, match="65535"):
        blobs.encode_urls(pts.withColumn("url", F.repeat(F.lit("x"), 65536))).collect()


def test_subset_shards_and_receipts(spark):
    ok = spark.createDataFrame([("a", 0, 3), ("a", 1, 4), ("a", 2, 5), ("b", 0, 9)], "subset string, id long, n_bytes long")
    assert rows(blobs.pack_subset_shards(ok, 2)) == [("a", 0, 0, 0, 3), ("a", 0, 1, 3, 4), ("a", 1, 2, 0, 5), ("b", 0, 0, 0, 9)]
    assert blobs.dense_per_subset(ok).isEmpty() and rows(blobs.dense_per_subset(ok.filter("id <> 1")), "subset") == [("a",)]
    with pytest.raises(Exception, match="oversize"):
        blobs.pack_subset_shards(ok.withColumn("n_bytes", F.lit(0).cast("long"))).collect()
    src = spark.createDataFrame([(0, 0, b"abc"), (0, 1, b"de"), (1, 0, b"f")], "shard long, local long, payload binary")
    rec = blobs.build_receipts(src, src.withColumn("payload", F.when(F.col("local") == 0, F.col("payload"))), "b1")
    assert rows(rec, "shard", "n_rows", "n_valid", "n_missing", "source_bytes", "target_bytes") == [(0, 2, 1, 1, 5, 3), (1, 1, 1, 0, 1, 1)]
    shards = spark.createDataFrame([(0,), (1,), (2,)], "shard long")
    assert rows(blobs.pending_shards(shards, rec, "b1")) == [(2,)]
    with pytest.raises(Exception, match="another build"):
        blobs.pending_shards(shards, rec, "b2").collect()


def test_costs_are_exact_decimals(spark):
    df = spark.createDataFrame([("app", ".00004")] * 10, "app string, cost string")
    assert {r.app: r.cost for r in metrics.cost_summary(df).collect()} == {"app": Decimal("0.0004"), None: Decimal("0.0004")}


def test_gauges_and_deltas(spark):
    day = lambda d: datetime(2026, 9, d)
    pts = [("standard", "r", day(6), 20.0), ("standard", "r", day(7), 30.0), ("nearline", "r", day(5), 5.0), ("nearline", "r", day(6), 8.0)]
    df = spark.createDataFrame(pts, "metric string, resource string, at timestamp, value double")
    assert metrics.summarize_metrics(df, True).first()[:] == (38.0, day(7), day(6))
    assert metrics.summarize_metrics(df.union(df), True).first().value == 38.0
    assert metrics.summarize_metrics(df, False).first().value == 63.0
    assert metrics.summarize_metrics(df.limit(0), True).first()[:] == (None, None, None)


@pytest.mark.parametrize("hot", [1, 10**9])
def test_carry_forward(spark, hot):
    data = [("p", i, i, float(i) if i in (0, 1, 7) else None) for i in range(12)] + [("q", 0, 0, None)]
    df = spark.createDataFrame(data, "provider string, seq long, at long, value double").repartition(3)
    got = {(r.provider, r.seq): (r.value, r.last_success_at) for r in metrics.carry_forward(df, 1, hot).collect()}
    assert got["p", 6] == (1.0, 1) and got["p", 7] == (7.0, 7) and got["p", 11] == (7.0, 7) and got["q", 0] == (None, None)


def test_release_gate(spark):
    df = spark.createDataFrame([("complete", 5), ("complete", 6)], "state string, rows long")
    assert metrics.release_gate(df, 11, 2).first().ready and not metrics.release_gate(df, 12, 2).first().ready
    failed = df.union(spark.createDataFrame([("failed", 0)], "state string, rows long"))
    assert metrics.release_gate(failed, 11, 3).first().stopped
    stalled = spark.createDataFrame([("running", 5, 1801)], "state string, rows long, age_seconds long")
    assert metrics.release_gate(stalled, 5, 1).first().stopped


def test_resumed_ingest_skips_finished_shards(spark, scratch):
    schema = "shard long, row long, payload string"
    shard = lambda i, text: spark.createDataFrame([(i, j, text) for j in range(3)], schema).coalesce(1)
    run = lambda: ingest.ingest_shards_stream(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/ck", schema).awaitTermination()
    shard(0, "a").write.mode("append").parquet(f"{scratch}/in")
    run()
    shard(1, "b").write.mode("append").parquet(f"{scratch}/in")
    shard(0, "c").write.mode("append").parquet(f"{scratch}/in")  # a second file of the first shard
    run()
    run()
    assert rows(ingest.read_ingested(spark, f"{scratch}/out").groupBy("shard", "payload").count()) == [(0, "a", 3), (0, "c", 3), (1, "b", 3)]
    assert rows(ingest.receipts(spark, f"{scratch}/out"), "batch", "shard", "n_rows") == [(0, "0", 3), (1, "0", 3), (1, "1", 3)]
    spark.read.parquet(f"{scratch}/in").write.parquet(f"{scratch}/out/rows/batch=9")  # rows of a batch that didn't finish
    assert ingest.read_ingested(spark, f"{scratch}/out").count() == 9


def test_streamed_hours_equal_the_batch(spark, scratch):
    start = datetime(2024, 1, 1)
    data = [(start + timedelta(minutes=i), "m", float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(data, "at timestamp, metric string, value double")
    df.coalesce(1).write.parquet(f"{scratch}/in")
    stream = ingest.hourly_usage_stream(spark.readStream.schema(df.schema).parquet(f"{scratch}/in"), ["metric"])
    q = stream.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = metrics.hourly_usage(df, ["metric"]).filter(F.col("hour") < F.lit(start + timedelta(hours=9)))
    assert rows(spark.read.parquet(f"{scratch}/out"), "hour", "metric", "value", "n") == rows(batch, "hour", "metric", "value", "n")
