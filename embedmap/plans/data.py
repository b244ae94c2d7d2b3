"""How the provided tables stand in for points, coordinates, vectors and metadata, in Spark and in check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from embedmap.operators import frames, voxels
from embedmap.plans.registry import part

GRID, VPC = 16, 4           # voxels per axis, voxels per chunk axis
G = GRID // VPC
ZOOM = 3


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A provided table. The schema is inferred once per path; later reads open no footer on the driver."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def long(c: str) -> Column:
    return F.col(c).cast("long")


# --- 3-D points: orders ---------------------------------------------------------------------------------------------

def points3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_totalprice") / 5000).alias("x"),
        ((F.col("o_custkey") % 1000).cast("double") / 10).alias("y"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double") / 24).alias("z"),
        F.col("o_orderpriority").alias("subset"),
        (F.col("o_orderkey") % 256).alias("r"),
        (F.col("o_custkey") % 256).alias("g"),
        (F.floor("o_totalprice") % 256).alias("b"),
    )


def frame3(spark: SparkSession, sf: str) -> frames.Frame:
    return frames.compute_frame_3d(points3(spark, sf))


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return frames.assign_points(points3(spark, sf), frame3(spark, sf), GRID, VPC)


def voxel_table(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.representatives(assigned(spark, sf), GRID)


def records(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.voxel_records(voxel_table(spark, sf), points3(spark, sf))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.chunk_summary(voxel_table(spark, sf), G)


part("p3", """
SELECT o_orderkey AS row_id, o_totalprice / 5000 AS x, CAST(o_custkey % 1000 AS DOUBLE) / 10 AS y,
       CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / 24 AS z,
       o_orderpriority AS subset, o_orderkey % 256 AS r, o_custkey % 256 AS g,
       CAST(floor(o_totalprice) AS BIGINT) % 256 AS b
FROM orders""")
part("q3", """
SELECT quantile_cont(x, 0.001) AS xa, quantile_cont(x, 0.999) AS xb, quantile_cont(y, 0.001) AS ya,
       quantile_cont(y, 0.999) AS yb, quantile_cont(z, 0.001) AS za, quantile_cont(z, 0.999) AS zb FROM p3""")


def _pad(lo: str, hi: str) -> str:
    return f"CASE WHEN {hi} = {lo} THEN 1.0::DOUBLE ELSE 0.02::DOUBLE * ({hi} - {lo}) END"


part("raw3", "SELECT " + ", ".join(
    f"{a}a - ({_pad(a + 'a', a + 'b')}) AS {a}0, {a}b + ({_pad(a + 'a', a + 'b')}) AS {a}1" for a in "xyz") + " FROM q3")
part("half3", "SELECT *, greatest(x1 - x0, y1 - y0, z1 - z0) / 2 AS h FROM raw3")
part("f3", "SELECT " + ", ".join(
    f"({a}0 + {a}1) / 2 - h AS {a}0, ({a}0 + {a}1) / 2 + h AS {a}1" for a in "xyz") + " FROM half3")
part("n3", "SELECT p3.*, " + ", ".join(
    f"({a} - {a}0) / ({a}1 - {a}0) * 2.0::DOUBLE - 1.0::DOUBLE AS p{a}" for a in "xyz") + " FROM p3, f3")
part("v3", "SELECT *, " + ", ".join(
    f"CAST(least(greatest(floor((p{a} + 1) / 2 * {GRID}), 0), {GRID - 1}) AS BIGINT) AS v{a}" for a in "xyz") + " FROM n3")
part("a3", f"""
SELECT *, (vx // {VPC}) + {G} * ((vy // {VPC}) + {G} * (vz // {VPC})) AS chunk_id,
       (vx % {VPC}) + {VPC} * ((vy % {VPC}) + {VPC} * (vz % {VPC})) AS local_id,
       """ + " + ".join(
    f"(p{a} - ((v{a} + 0.5::DOUBLE) * ({2.0 / GRID!r}::DOUBLE) - 1)) * (p{a} - ((v{a} + 0.5::DOUBLE) * ({2.0 / GRID!r}::DOUBLE) - 1))"
    for a in "xyz") + " AS d2 FROM v3")
part("vox", """
SELECT chunk_id, local_id, row_id AS repr_row_id, n FROM (
  SELECT chunk_id, local_id, row_id, count(*) OVER (PARTITION BY chunk_id, local_id) AS n,
         row_number() OVER (PARTITION BY chunk_id, local_id ORDER BY d2, row_id) AS k FROM a3) WHERE k = 1""")
part("post", """
SELECT chunk_id, local_id, row_id, row_number() OVER (PARTITION BY chunk_id, local_id ORDER BY row_id) - 1 AS pos FROM a3""")
part("rec", """
SELECT v.chunk_id, v.local_id, v.n, CAST(coalesce(sum(v.n) OVER (PARTITION BY v.chunk_id ORDER BY v.local_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS point_offset,
       p.r, p.g, p.b, CAST(1 AS BIGINT) AS has_tile, v.repr_row_id
FROM vox v JOIN p3 p ON p.row_id = v.repr_row_id""")
part("summ", f"""
SELECT chunk_id, CAST(sum(n) AS BIGINT) AS n_points, count(*) AS n_occupied, max(n) AS max_n,
       chunk_id % {G} AS cx, chunk_id // {G} % {G} AS cy, chunk_id // {G * G} AS cz,
       CASE WHEN count(*) <= 1 THEN 1 WHEN count(*) <= 4 THEN 2 WHEN count(*) <= 16 THEN 4 ELSE 8 END::BIGINT AS side
FROM vox GROUP BY chunk_id""")
part("ccol", """
SELECT chunk_id, """ + ", ".join(f"CAST(round_even(sum({c} * n) / sum(n), 0) AS BIGINT) AS {c}" for c in "rgb") +
     " FROM rec GROUP BY chunk_id")

# --- 2-D points: events ---------------------------------------------------------------------------------------------

CORPORA = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def points2(spark: SparkSession, sf: str) -> DataFrame:
    """Events as 2-D points: value against hours of the month; the corpus is the event type."""
    from embedmap.operators.keys import encode_subset

    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    df = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.col("value").alias("x"), (micros / 3600e6).alias("y"), "event_type")
    return encode_subset(df, "event_type", CORPORA, "corpus").select("row_id", "x", "y", "corpus")


def frame2(spark: SparkSession, sf: str) -> frames.Frame:
    return frames.compute_frame_2d(points2(spark, sf))


def quantized(spark: SparkSession, sf: str) -> DataFrame:
    return frames.quantize(points2(spark, sf), frame2(spark, sf)).select("row_id", "corpus", "qx", "qy")


part("p2", """
SELECT event_id AS row_id, value AS x, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600e6 AS y,
  CASE event_type """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CORPORA.items()) + """ END::BIGINT AS corpus FROM events""")
part("med2", "SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM p2")
part("rad2", "SELECT p2.*, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS radius FROM p2, med2")
part("core2", "SELECT * FROM rad2 WHERE radius <= (SELECT quantile_cont(radius, 0.995) FROM rad2)")
part("q2", """SELECT quantile_cont(x, 0.001) AS xa, quantile_cont(x, 0.999) AS xb, quantile_cont(y, 0.001) AS ya,
  quantile_cont(y, 0.999) AS yb FROM core2""")
part("raw2", "SELECT " + ", ".join(
    f"{a}a - ({_pad(a + 'a', a + 'b')}) AS {a}0, {a}b + ({_pad(a + 'a', a + 'b')}) AS {a}1" for a in "xy") + " FROM q2")
part("f2", "SELECT " + ", ".join(
    f"({a}0 + {a}1) / 2 - greatest(x1 - x0, y1 - y0) / 2 AS {a}0, ({a}0 + {a}1) / 2 + greatest(x1 - x0, y1 - y0) / 2 AS {a}1"
    for a in "xy") + " FROM raw2")
part("z2", """
SELECT row_id, corpus, CAST(least(greatest(floor((x - x0) / (x1 - x0) * 65536), 0), 65535) AS BIGINT) AS qx,
       CAST(least(greatest(floor((y1 - y) / (y1 - y0) * 65536), 0), 65535) AS BIGINT) AS qy FROM p2, f2""")
part("b2", f"SELECT *, qx >> {8 - ZOOM} AS bin_x, qy >> {8 - ZOOM} AS bin_y FROM z2")
part("t2", f"""
SELECT *, (bin_y >> 8) * {1 << ZOOM} + (bin_x >> 8) AS tile, """ + " + ".join(
    f"((bin_x >> {i}) & 1) * {1 << 2 * i} + ((bin_y >> {i}) & 1) * {2 << 2 * i}" for i in range(8)) + " AS morton FROM b2")
part("til", "SELECT row_number() OVER (ORDER BY tile, morton, row_id) - 1 AS pos, * FROM t2")
part("pyr", f"""
SELECT CAST(z AS BIGINT) AS z, corpus, qx >> (8 - z) AS bin_x, qy >> (8 - z) AS bin_y, count(*) AS n
FROM z2, (SELECT unnest(range({ZOOM + 1})) AS z) GROUP BY 1, 2, 3, 4""")
