"""The guarded build: what it publishes, and what stops it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from embedmap.operators import build
from embedmap.operators.keys import ContractError
from embedmap.sources import release
from tests.conftest import rows


def points(spark, n=400):
    h = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 100).alias(k)
    return spark.range(n).select(F.col("id").alias("row_id"), h("x"), h("y"), h("z"), *[(F.col("id") % 256).alias(c) for c in "rgb"])


def test_a_build_is_complete_and_audited(spark, scratch):
    out = build.build_map(points(spark), scratch, "r1", 16, 4)
    assert out["tables"] == ["bricks", "chunks", "frame", "octree", "points", "postings", "records", "voxels"]
    tables = release.read_release(spark, scratch, "r1")
    assert tables["points"].count() == tables["postings"].count() == 400 and build.map_problems(tables, 16, 4).isEmpty()
    broken = {**tables, "postings": tables["postings"].filter("row_id > 0"), "voxels": tables["voxels"].withColumn("n", F.col("n") + 1)}
    assert {r[0] for r in rows(build.map_problems(broken, 16, 4))} >= {"rows of postings", "rows of voxels"}


@pytest.mark.parametrize("spoil,message", [
    (lambda p: p.filter("row_id != 7"), "not dense"),
    (lambda p: p.withColumn("y", F.when(F.col("row_id") == 7, F.lit(float("nan"))).otherwise(F.col("y"))), "not finite"),
    (lambda p: p.withColumn("z", F.when(F.col("row_id") == 7, F.lit(None)).otherwise(F.col("z"))), "not finite"),
    (lambda p: p.withColumn("x", F.lit(1.0)).withColumn("y", F.lit(1.0)).withColumn("z", F.lit(1.0)), "more than 100"),
])
def test_a_failed_build_publishes_nothing(spark, scratch, spoil, message):
    build.build_map(points(spark), scratch, "r1", 16, 4, limit=100)
    with pytest.raises(ContractError, match=message):
        build.build_map(spoil(points(spark)), scratch, "r2", 16, 4, limit=100)
    assert release.current_release(spark, scratch) == "r1"
