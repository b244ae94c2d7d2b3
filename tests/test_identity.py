from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from embedmap.functions import codec
from embedmap.operators import keys
from tests.conftest import rows


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_provenance_needs_path_position_and_id(spark):
    pool = frame(spark, "pool_row long, shard long, local_row long, pool_id string", (0, 1, 1, "b1"), (1, 0, 0, "a0"), (2, 1, 0, "b0"), (3, 0, 1, "a1"))
    paths = frame(spark, "shard long, path string", (0, "a"), (1, "b"))
    training = frame(spark, "row_id long, path string, local_row long, image_id string",
                     (0, "b", 0, "b0"), (1, "b", 1, "b1"), (2, "a", 0, "a0"), (3, "a", 1, "a1"))
    joined = keys.provenance_join(training, pool, paths)
    assert rows(joined, "row_id", "pool_row") == [(0, 2), (1, 0), (2, 1), (3, 3)]
    assert keys.provenance_violations(joined).isEmpty()
    wrong = keys.provenance_join(training.withColumn("image_id", F.lit("b0")), pool, paths)
    assert keys.provenance_violations(wrong).count() == 3
    twice = keys.provenance_join(training.unionByName(training.filter("row_id = 0").withColumn("row_id", F.lit(4).cast("long"))), pool, paths)
    assert rows(keys.provenance_violations(twice), "row_id", "problem") == [(0, "pool row used twice"), (4, "pool row used twice")]


def identity(spark):
    map_rows = frame(spark, "row_id long, shard long, image_id string", (0, 0, "A"), (1, 1, "A"), (2, 0, "B"), (3, 0, "C"))
    paths = frame(spark, "shard long, path string", (0, "v1.2.0/one"), (1, "v1.2.0/two"))
    catalog = frame(spark, "path string, image_id string, hash string", ("one", "A", "h1"), ("two", "A", "h2"), ("one", "B", "collision"), ("one", "C", "collision"))
    ann = frame(spark, "ann_id long, hash string", (0, "h2"), (1, "collision"), (2, "h1"), (3, "collision"))
    return keys.identity_rows(map_rows, paths, catalog), ann


def test_collisions_are_never_guessed(spark):
    found, ann = identity(spark)
    assert keys.unmatched_identity(found, ann).isEmpty()
    mapping = keys.collision_map(found, ann)
    assert rows(mapping, "ann_id", "row_id") == [(0, 1), (1, keys.MISSING), (2, 0), (3, keys.MISSING)]
    candidates = mapping.filter("n_candidates > 1").join(keys.collision_candidates(found).withColumnRenamed("row_id", "c"), "hash")
    assert rows(candidates, "ann_id", "c") == [(1, 2), (1, 3), (3, 2), (3, 3)]


def test_stored_codes_resolve_collisions(spark):
    found, ann = identity(spark)
    mapping, cand = keys.collision_map(found, ann), keys.collision_candidates(found)
    row_codes = frame(spark, "row_id long, code string", (2, "x"), (3, "y"))
    ann_codes = frame(spark, "ann_id long, code string", (1, "y"), (3, "x"))
    solved = keys.resolve_collisions(mapping, cand, ann_codes, row_codes)
    assert rows(solved, "ann_id", "row_id", "status") == [(1, 3, "resolved"), (3, 2, "resolved")]
    same = keys.resolve_collisions(mapping, cand, ann_codes, row_codes.withColumn("code", F.lit("x")))
    assert rows(same, "ann_id", "status") == [(1, "no match"), (3, "unresolved")]
    final = mapping.select("ann_id", "row_id").filter("row_id >= 0").unionByName(solved.select("ann_id", "row_id"))
    assert all(r.dense for r in keys.check_permutation(final, "ann_id", "row_id").collect())


def test_a_hash_shared_by_a_third_of_all_rows_makes_no_pairs(spark):
    n = 3000
    ids = spark.range(n)
    h = F.when(F.col("id") < n // 3, F.lit("hot")).otherwise(F.col("id").cast("string"))
    found, ann = ids.select(F.col("id").alias("row_id"), h.alias("hash")), ids.select(F.col("id").alias("ann_id"), h.alias("hash"))
    mapping = keys.collision_map(found, ann)
    assert mapping.count() == n and mapping.filter("n_candidates = 1000").count() == 1000
    assert keys.collision_candidates(found).count() == 1000


def test_row_order_follows_the_shards(spark):
    shards = frame(spark, "seq long, shard long, n_rows long", (0, 1, 2), (1, 0, 1))
    good = frame(spark, "row_id long, ref long", (0, 65536), (1, 65537), (2, 0))
    assert keys.verify_row_order(good, shards).isEmpty()
    swapped = frame(spark, "row_id long, ref long", (0, 65537), (1, 65536), (2, 0))
    assert rows(keys.verify_row_order(swapped, shards), "row_id") == [(0,), (1,)]


def test_dense_and_duplicate_checks(spark):
    assert keys.check_dense(spark.range(10), "id").first().dense
    assert not keys.check_dense(spark.range(1, 10), "id").first().dense
    assert not keys.check_dense(spark.range(10), "id", 11).first().dense
    assert not keys.check_dense(spark.range(10).union(spark.range(1)), "id").first().dense
    assert keys.check_dense(spark.range(0), "id").first().dense
    assert rows(keys.duplicate_keys(spark.range(3).union(spark.range(2)).union(spark.range(1)), ["id"])) == [(0, 2), (1, 1)]


def test_one_to_one_join_refuses(spark):
    a = frame(spark, "k long, a long", (1, 1), (2, 2))
    assert keys.one_to_one_join(a, frame(spark, "k long, b long", (1, 5), (2, 6)), ["k"]).count() == 2
    for other in ([(1, 5)], [(1, 5), (2, 6), (2, 7)], [(1, 5), (2, 6), (3, 7)]):
        with pytest.raises(keys.ContractError):
            keys.one_to_one_join(a, frame(spark, "k long, b long", *other), ["k"])


def test_enrichment_keeps_rows(spark):
    points = frame(spark, "k long", (1,), (2,), (3,))
    lookup = frame(spark, "k long, url string, width long, height long", (1, "", -5, 7), (2, "u", 3, 4))
    assert rows(keys.enrich_left(points, lookup, ["k"]).na.fill("-"), "k", "url", "width", "height") == [(1, "-", 0, 7), (2, "u", 3, 4), (3, "-", 0, 0)]


def test_dictionary_is_frozen(spark):
    df = frame(spark, "s string", ("a",), ("b",))
    assert rows(keys.encode_subset(df, "s", {"a": 0, "b": 3}), "s", "code") == [("a", 0), ("b", 3)]
    with pytest.raises(Exception, match="unknown s"):
        keys.encode_subset(df, "s", {"a": 0}).collect()
    with pytest.raises(keys.ContractError):
        keys.checked_mapping({"a": 1, "b": 0}, {"a": 0})
    with pytest.raises(keys.ContractError):
        keys.checked_mapping({str(i): i for i in range(17)})
    assert keys.checked_mapping({"a": 0, "b": 1}, {"a": 0})["b"] == 1


def test_draw_must_ascend(spark):
    idx = frame(spark, "row_id long, pool_row long", (0, 3), (1, 7), (2, 7), (3, 9))
    assert rows(keys.draw_violations(idx), "row_id") == [(2,)]
    assert keys.select_draw(frame(spark, "pool_row long, m string", (3, "x"), (7, "y"), (9, "z")), idx).count() == 4


def test_refs_out_of_range(spark):
    df = frame(spark, "s long, l long", (0, 0), (65536, 0), (1, 65536), (-1, 2), (None, 1))
    assert keys.ref_violations(df, "s", "l").count() == 4
    assert df.limit(1).select(codec.pack_ref(F.col("s"), F.col("l"))).first()[0] == 0


def test_samples_do_not_depend_on_layout(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    a = rows(keys.stratified_sample(df.repartition(1), "g", 5, 1))
    assert a == rows(keys.stratified_sample(df.repartition(7), "g", 5, 1)) and len(a) == 15
    held = keys.stratified_sample(df, "g", 5, 1)
    rest = keys.training_sample(df.repartition(5), held, 50, 2)
    assert rest.count() == 50 and rest.join(held, "row_id").isEmpty()
    assert rows(rest) == rows(keys.training_sample(df.repartition(2), held, 50, 2))


def test_concat_and_extend(spark):
    parts = [(spark.range(3).withColumnRenamed("id", "row_id"), 3), (spark.range(2).withColumnRenamed("id", "row_id"), 2)]
    assert rows(keys.concat_corpora(parts)) == [(i,) for i in range(5)]
    meta = frame(spark, "row_id long, url string, url_len long, width long, height long", (0, "u", 1, 2, 3))
    assert rows(keys.extend_metadata(meta, 2).na.fill("-"), "row_id", "url", "url_len", "width") == [(0, "u", 1, 2), (1, "-", 0, 0)]


def test_joins_refuse_rows_without_a_partner(spark):
    idx, pool = frame(spark, "row_id long, pool_row long", (0, 3), (1, 4)), frame(spark, "pool_row long, m string", (3, "x"))
    assert rows(keys.unmatched(idx, pool, ["pool_row"]), "row_id") == [(1,)]
    with pytest.raises(Exception, match="not in the pool"):
        keys.select_draw(pool, idx).collect()
    points = frame(spark, "row_id long, shard long, local_row long", (0, 1, 2))
    store = frame(spark, "shard long, local_row long, url string, width long, height long", (1, 2, "u", -5, 7))
    assert rows(keys.gather_by_ref(points, store), "width", "height") == [(0, 7)]


def test_a_row_listed_twice_is_one_candidate(spark):
    found = frame(spark, "row_id long, hash string", (5, "h"), (5, "h"))
    assert rows(keys.collision_map(found, frame(spark, "ann_id long, hash string", (0, "h"))), "row_id", "n_candidates") == [(5, 1)]
