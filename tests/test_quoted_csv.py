"""Quoted CSV in byte ranges against Python's reader."""

from __future__ import annotations

import csv
import io
import os

import pytest
from pyspark.sql import functions as F

from embedmap.sources import inventory_csv, quoted_csv
from tests.conftest import rows

CELLS = ["plain", 'say "hi"', "two\nlines", "", "a,b", '"', '""\n"', "\n\n", "x" * 300, "é\n," * 5, "tail\r\n next"]


def table(n):
    return [[str(i), CELLS[i % len(CELLS)], CELLS[i * 7 % len(CELLS)]] for i in range(n)]


@pytest.mark.parametrize("size", ["64b", "1k", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_those_of_a_sequential_reader(spark, scratch, size, end):
    os.makedirs(f"{scratch}/in")
    want = []
    for f in range(2):
        data = io.StringIO()
        csv.writer(data, lineterminator=end, quoting=csv.QUOTE_ALL if f else csv.QUOTE_MINIMAL).writerows(table(120 + f))
        with open(f"{scratch}/in/{f}.csv", "w", newline="") as out:
            out.write(data.getvalue())
        want += list(csv.reader(io.StringIO(data.getvalue(), newline="")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = quoted_csv.read_records(spark, f"{scratch}/in")
        if size == "1k":
            assert quoted_csv.read_lines(spark, f"{scratch}/in").rdd.getNumPartitions() > 10
        got = [r.text for r in records.orderBy("line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [next(csv.reader(io.StringIO(t, newline=""))) for t in got] == want


def test_an_inventory_file_is_read_in_ranges_and_broken_ones_refused(spark, scratch):
    lines = [inventory_csv.COLUMNS]
    for v in range(40):
        for i in range(3):
            block = ["3", str(100 * v), "2", "7;8", "1", "2", ""] if i == 0 else [""] * 7
            lines.append(["1", 'set "a",\nb', "pack", "0", str(v), str(100 * v + i), f"http://x/{i}\n?", *block])
    data = io.StringIO()
    csv.writer(data, quoting=csv.QUOTE_ALL).writerows(lines)
    os.makedirs(f"{scratch}/in")
    with open(f"{scratch}/in/a.csv", "w", newline="") as out:
        out.write("﻿" + data.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        df = inventory_csv.read_inventory_csv(spark, f"{scratch}/in")
        assert df.count() == 120 and rows(df.select("dataset").distinct()) == [('set "a",\nb',)]
        stacks, held = inventory_csv.inventory_from_csv(df)
        assert stacks.count() == 40 and held.filter("state = 'held'").count() == 120 and held.filter("state = 'returned'").count() == 80
        order = [r.row_id for r in df.orderBy("line").collect()]
        assert order == [line[5] for line in lines[1:]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(Exception, match="broken inventory CSV"):
        inventory_csv.inventory_from_csv(df.withColumn("total_points", F.lit("6")))
