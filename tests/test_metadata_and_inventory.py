from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from embedmap.operators import inventory, metadata
from embedmap.sources import inventory_csv
from tests.conftest import rows

TYPES = ("covers", "plates")


@pytest.fixture(scope="module")
def catalogue(spark):
    books = spark.createDataFrame([("000000001", "A 100% book", "Author", "", "London")], "id string, title string, author string, publisher string, place string")
    images = spark.createDataFrame([
        (0, "covers", 0, "000000001", None, 0, 0, 0, "000000001_0.jpg", None, "7"),
        (1, "covers", 1, "000000001", 1801, 0, 1, 0, "000000001_1.jpg", None, "7"),
        (2, "covers", 2, "000000001", 1802, 0, 0, 1, "000000001_2.jpg", None, "7"),
        (3, "covers", 3, "000000001", 1803, 0, 1, 1, "000000001_3.jpg", None, "7"),
        (4, "plates", 0, "000000002", 1804, 1, 0, 2, "000000002_4.jpg", None, "7"),
        (5, "plates", 1, "000000002", 1805, 1, 1, 2, "000000002_5.jpg", None, "7"),
        (6, "plates", 2, "000000002", 1806, 1, 0, 3, "000000002_6.jpg", None, "7"),
        (7, "plates", 3, "000000002", 1807, 1, 1, 3, "000000002_7.jpg", None, "7")],
        "row_id long, subset string, local_idx long, book string, year int, chunk_id long, local_id long, pos long, fname string, volume string, page string")
    return images, books


@pytest.mark.parametrize("value,want", [
    ({"type": "covers"}, [0, 1, 2, 3]),
    ({"type": "covers", "minYear": 1802, "maxYear": 1803}, [2, 3]),
    ({"type": "covers", "minYear": 1802, "includeUnknown": True}, [0, 2, 3]),
    ({"book": "000000002", "maxYear": 1805}, [4, 5]),
    ({"book": "000000009"}, []),
    ({}, list(range(8))),
])
def test_filters(catalogue, value, want):
    got = metadata.filter_rows(catalogue[0], value, TYPES)
    assert [r[0] for r in rows(got, "row_id")] == want
    mask = metadata.row_mask(got)
    assert [r[0] for r in rows(metadata.mask_rows(mask))] == want
    assert metadata.check_snapshot(mask, metadata.filter_counts(got), 8, 2, 2).first().ok


def test_mask_is_lowest_bit_first(catalogue):
    mask = metadata.row_mask(catalogue[0].filter("row_id in (0, 3, 7)")).first()
    assert mask.bucket == 0 and bytes(mask.mask)[0] == 0b10001001 and len(mask.mask) == 4096


def test_mask_crosses_buckets(spark):
    ids = [0, 32767, 32768, 70000]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    assert [r[0] for r in rows(metadata.mask_rows(metadata.row_mask(df)))] == ids


def test_inconsistent_snapshot_is_refused(catalogue):
    got = metadata.filter_rows(catalogue[0], {"type": "covers"}, TYPES)
    counts = metadata.filter_counts(got)
    assert rows(counts, "chunk_id", "local_id", "n") == [(0, 0, 2), (0, 1, 2)]
    assert not metadata.check_snapshot(metadata.row_mask(got), counts.withColumn("n", F.col("n") + 1), 8, 2, 2).first().ok
    assert not metadata.check_snapshot(metadata.row_mask(got), counts.union(counts.limit(1)), 8, 2, 2).first().ok
    with pytest.raises(ValueError):
        metadata.check_identity({"digest": "a", "rows": 1}, {"digest": "b", "rows": 1})


@pytest.mark.parametrize("bad", [
    {"x": 1}, {"type": "maps"}, {"minYear": "1800"}, {"minYear": -1}, {"maxYear": 2101}, {"minYear": 1900, "maxYear": 1800}, {"includeUnknown": 1},
    {"book": "12"}, {"minYear": True}, [],
])
def test_invalid_filters(bad):
    with pytest.raises(ValueError):
        metadata.metadata_predicate(bad, TYPES)


def test_book_lookup(catalogue):
    images, books = catalogue
    find = lambda q: rows(metadata.find_books(books, images, q))
    assert find("100%") == [("000000001", "A 100% book")] and find("%_") == [] and find("a") == []
    assert find("000000002") == [("000000002", "000000002")] and find("bOOk") == [("000000001", "A 100% book")] and find("x" * 121) == []


def test_detail(spark, catalogue):
    images, books = catalogue
    detail = metadata.image_detail(images, books, spark.createDataFrame([(0,), (5,)], "row_id long"))
    assert rows(detail, "row_id", "title", "provenance") == [(0, "A 100% book", "catalog title"), (5, "000000002_5.jpg", "source filename")]
    fields = rows(metadata.image_fields(detail), "row_id", "label", "value")
    assert (0, "Place", "London") in fields and not any(f[1] in ("Publisher", "Volume") for f in fields)
    assert (5, "Publication year (recorded)", "1805") in fields and not any(f[0] == 0 and f[1].startswith("Publication") for f in fields)


def test_images_need_a_book(spark):
    pts = spark.createDataFrame([(0, "covers", 0, "000000001_a.jpg", "1850"), (1, "covers", 1, "000000001_b.jpg", "c. 1850")],
                                "row_id long, subset string, local_idx long, fname string, date string")
    post = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 1, 0)], "row_id long, chunk_id long, local_id long, pos long")
    src = spark.createDataFrame([("000000001_a.jpg", "covers", "1", "2")], "fname string, subset string, volume string, page string")
    assert rows(metadata.build_images(pts, post, src).na.fill(-1), "row_id", "book", "year") == [(0, "000000001", 1850), (1, "000000001", -1)]
    with pytest.raises(Exception, match="missing book"):
        metadata.build_images(pts.withColumn("fname", F.lit("x.jpg")), post, src).collect()
    with pytest.raises(ValueError):
        metadata.build_images(pts, post, src.union(src))
    with pytest.raises(Exception, match="without a posting"):
        metadata.build_images(pts, post.filter("row_id = 0"), src).collect()


def test_filtered_cell_takes_the_first_largest(spark):
    counts = spark.createDataFrame([(0, 0, 2), (0, 1, 3), (0, 4, 3)], "chunk_id long, local_id long, n long")
    r = metadata.filtered_cells(counts, 4, 2).first()
    assert (r.total, r.max_n, r.best_local) == (8, 3, 1)


# --- inventory --------------------------------------------------------------------------------------------------------

POSTINGS = [(0, 0, 10 + i, i) for i in range(6)] + [(0, 1, 30, 0)]


def log(spark, *events):
    return spark.createDataFrame([(0, v, r, p, op, s, c) for s, (v, r, p, op, c) in enumerate(events)],
                                 "chunk_id long, local_id long, row_id long, pos long, op string, seq long, cursor_after long")


def state(spark, *events, **kw):
    live = inventory.replay(log(spark, *events), **kw)
    stacks = inventory.stacks_of(live)
    return stacks, inventory.rows_of(live, stacks)


def postings(spark):
    return spark.createDataFrame(POSTINGS, "chunk_id long, local_id long, row_id long, pos long")


EVENTS = [
    (0, 10, 0, "extract", 1), (0, 11, 1, "extract", 2), (0, 12, 2, "extract", 3), (0, 11, 1, "return", 3), (0, 10, 0, "return", 3),
    (0, 14, 4, "extract", 3),  # through a filter: selected
]


@pytest.mark.parametrize("hot", [1, 10**9])
def test_replay_and_next_batch(spark, hot):
    stacks, held = state(spark, *EVENTS, hot_rows=hot, split_bits=1)
    assert rows(stacks, "local_id", "cursor", "first_seq", "last_seq") == [(0, 3, 0, 5)]
    assert rows(held, "row_id", "state", "selected") == [(10, "returned", False), (11, "returned", False), (12, "held", False), (14, "held", True)]
    got = inventory.next_batch(postings(spark), held, stacks, 4)
    assert rows(got, "local_id", "take", "row_id") == [(0, 1, 11), (0, 2, 10), (0, 3, 13), (0, 4, 15), (1, 1, 30)]
    matches = spark.createDataFrame([(10,), (12,), (14,), (15,), (30,)], "row_id long")
    filtered = inventory.next_batch_filtered(postings(spark), held, matches, 5)
    assert rows(filtered, "local_id", "take", "row_id") == [(0, 1, 10), (0, 2, 15), (1, 1, 30)]


def test_emptied_stack_leaves_nothing(spark):
    stacks, held = state(spark, (0, 10, 0, "extract", 1), (0, 10, 0, "return", 1), (1, 30, 0, "extract", 1))
    assert rows(stacks, "local_id", "cursor") == [(1, 1)] and rows(held, "row_id") == [(30,)]
    again, rows_again = state(spark, (0, 10, 0, "extract", 1), (0, 10, 0, "return", 1), (0, 10, 0, "extract", 1))
    assert rows(again, "cursor", "first_seq") == [(1, 2)] and rows(rows_again, "row_id", "state") == [(10, "held")]


def test_drain(spark):
    _, held = state(spark, *EVENTS)
    vox = spark.createDataFrame([(0, 0, 10, 6), (0, 1, 30, 1)], "chunk_id long, local_id long, repr_row_id long, n long")
    assert rows(inventory.drain_status(vox, held), "local_id", "extracted", "total", "complete") == [(0, 2, 6, False), (1, 0, 1, False)]
    m = spark.createDataFrame([(12,), (14,)], "row_id long")
    assert rows(inventory.drain_status(vox, held, postings(spark), m), "local_id", "extracted", "total", "fraction", "complete") == [
        (0, 2, 2, 1.0, True), (1, 0, 0, 0.0, True)]


def saved(spark):
    stacks, held = state(spark, *EVENTS)
    meta = spark.createDataFrame([(0, 0, 6, 10)], "chunk_id long, local_id long, total_points long, repr_row_id long")
    return stacks.join(meta, ["chunk_id", "local_id"]), held


def test_save_validation_and_prefix(spark):
    stacks, held = saved(spark)
    vox = spark.createDataFrame([(0, 0, 10, 6)], "chunk_id long, local_id long, repr_row_id long, n long")
    assert inventory.validate_inventory(stacks, held, 100, 1, 2).isEmpty()
    assert inventory.verify_prefix(stacks, held, postings(spark), vox).isEmpty()
    assert rows(inventory.validate_inventory(stacks.withColumn("cursor", F.lit(4).cast("long")), held, 100, 1, 2), "problem") == [("arithmetic",)]
    assert ("duplicate stack",) in rows(inventory.validate_inventory(stacks.union(stacks), held, 100, 1, 2), "problem")
    assert ("duplicate or invalid row",) in rows(inventory.validate_inventory(stacks, held, 12, 1, 2), "problem")
    moved = held.withColumn("row_id", F.when(F.col("row_id") == 12, 13).otherwise(F.col("row_id")))
    assert rows(inventory.verify_prefix(stacks, moved, postings(spark), vox), "row_id", "problem") == [(12, "missing from save"), (13, "not in the prefix")]
    wrong = held.withColumn("row_id", F.when(F.col("row_id") == 14, 30).otherwise(F.col("row_id")))
    assert rows(inventory.verify_prefix(stacks, wrong, postings(spark), vox), "problem") == [("selected elsewhere",)]
    assert ("block metadata",) in rows(inventory.verify_prefix(stacks, held, postings(spark), vox.withColumn("n", F.lit(7).cast("long"))), "problem")


def test_csv_round_trip_with_commas_and_quotes(spark, scratch):
    stacks, held = saved(spark)
    urls = spark.createDataFrame([(12, 'https://h/a,"b"\nc'), (14, "u")], "row_id long, url string")
    csv = inventory_csv.inventory_to_csv(stacks, held, urls, 'data, "set"', "pack")
    inventory_csv.write_inventory_csv(csv, f"{scratch}/csv")
    back = inventory_csv.read_inventory_csv(spark, f"{scratch}/csv")
    assert rows(back, "row_id", "thumbnail_url") == [("12", 'https://h/a,"b"\nc'), ("14", "u")]
    assert inventory_csv.csv_violations(back).isEmpty()
    s, r = inventory_csv.inventory_from_csv(back)
    assert rows(s, *stacks.columns) == rows(stacks)
    assert rows(r, "row_id", "state", "selected") == rows(held, "row_id", "state", "selected")
    order = [x.row_id for x in r.filter("state = 'returned'").orderBy("seq").collect()]
    assert order == [11, 10]


def test_the_lists_of_a_block_meet_its_first_line_only(spark):
    """What is shuffled for the CSV grows with the rows, not with the rows times the length of their block's lists."""
    n = 3000
    held = spark.range(n).selectExpr("0L as chunk_id", "0L as local_id", "id as row_id", "if(id < 1500, 'held', 'returned') as state", "id % 3 = 0 and id < 1500 as selected", "id as seq")
    stacks = spark.createDataFrame([(0, 0, n, 0, n, 5)], "chunk_id long, local_id long, cursor long, first_seq long, total_points long, repr_row_id long").withColumn("last_seq", F.lit(9).cast("long"))
    urls = spark.range(n).selectExpr("id as row_id", "concat('u', id) as url")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        csv = inventory_csv.inventory_to_csv(stacks, held, urls, "d", "p")
        got = csv.orderBy("line")
        lines = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.line for r in lines] == list(range(1500)) and lines[0].returned_row_ids == ";".join(str(i) for i in range(1500, n))
    assert lines[0].selected_row_ids == ";".join(str(i) for i in range(0, 1500, 3)) and all(r.returned_row_ids == "" for r in lines[1:])
    size, todo = 0, [got._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
        if name == "Exchange":
            size += node.metrics().apply("dataSize").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < size < 3_000_000  # 1,500 lines with lists of 9 KB are 13 MB


def test_csv_refusals(spark, scratch):
    stacks, held = saved(spark)
    urls = spark.createDataFrame([(12, "u")], "row_id long, url string")
    csv = inventory_csv.inventory_to_csv(stacks, held, urls, "d", "p")
    problems = lambda df: [r[0] for r in rows(inventory_csv.csv_violations(df), "problem")]
    assert problems(csv.withColumn("dataset", F.col("row_id"))) == ["mixed datasets"]
    assert problems(csv.withColumn("total_points", F.lit("6"))) == ["block metadata"]
    assert problems(csv.withColumn("row_id", F.lit("x"))) == ["invalid integer", "invalid integer"]
    with open(f"{scratch}/bad.csv", "w") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(ValueError):
        inventory_csv.read_inventory_csv(spark, f"{scratch}/bad.csv")
