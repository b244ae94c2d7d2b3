"""Frames, coordinates and voxel addressing on the order points."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedmap.functions import grid
from embedmap.operators import frames
from embedmap.plans.data import G, GRID, VPC, frame3, long, points3, table
from embedmap.plans.registry import part, query


def edges(spark, values, names):
    """A frame as a one-row table, rounded to nine decimals."""
    row = spark.range(1).select(*[F.round(F.lit(float(v)), 9).alias(n) for v, n in zip(values, names)])
    return row


def sql_edges(source, names):
    return "SELECT " + ", ".join(f"round({n}, 9) AS {n}" for n in names) + f" FROM {source}"


E3 = ["x0", "x1", "y0", "y1", "z0", "z1"]


@query("robust_extent", sql_edges("raw3", E3))
def robust_extent(spark, sf):
    df = points3(spark, sf)
    return edges(spark, frames.robust_extent(df, ["x", "y", "z"]), E3)


@query("exact_percentiles", """
SELECT o_orderpriority AS subset, 'x' AS col, p, round(CASE p WHEN 0.001 THEN a WHEN 0.5 THEN b ELSE c END, 9) AS value FROM (
  SELECT o_orderpriority, quantile_cont(o_totalprice / 5000, 0.001) AS a, quantile_cont(o_totalprice / 5000, 0.5) AS b,
         quantile_cont(o_totalprice / 5000, 0.995) AS c FROM orders GROUP BY 1),
  (SELECT unnest([0.001::DOUBLE, 0.5::DOUBLE, 0.995::DOUBLE]) AS p)""")
def exact_percentiles(spark, sf):
    from embedmap.operators.ordering import exact_percentiles as run

    out = run(points3(spark, sf), ["subset"], ["x"], [0.001, 0.5, 0.995])
    return out.withColumn("value", F.round("value", 9))


@query("cubify", sql_edges("f3", E3))
def cubify(spark, sf):
    df = points3(spark, sf)
    return edges(spark, frames.equalized(frames.robust_extent(df, ["x", "y", "z"])), E3)


@query("frame_3d", sql_edges("f3", E3))
def frame_3d(spark, sf):
    return edges(spark, frame3(spark, sf).extent, E3)


part("s3n", "SELECT count(*) AS n, count(*) // 10 AS k FROM p3")
part("s3", "SELECT * FROM p3 WHERE row_id IN (SELECT i * (n - 1) // (k - 1) FROM (SELECT n, k, unnest(range(k)) AS i FROM s3n))")
part("s3q", "SELECT " + ", ".join(
    f"quantile_cont({c}, 0.001) AS {c}a, quantile_cont({c}, 0.999) AS {c}b" for c in "xyz") + " FROM s3")
part("s3r", "SELECT " + ", ".join(
    f"{c}a - 0.02::DOUBLE * ({c}b - {c}a) AS {c}0, {c}b + 0.02::DOUBLE * ({c}b - {c}a) AS {c}1" for c in "xyz") + " FROM s3q")
part("s3h", "SELECT *, greatest(x1 - x0, y1 - y0, z1 - z0) / 2 AS h FROM s3r")


@query("frame_3d_sampled", " UNION ALL ".join(
    f"SELECT '{c}{i}' AS edge, round(f3.{c}{i}, 9) AS whole, round((s3h.{c}0 + s3h.{c}1) / 2 {sign} h, 9) AS sampled FROM f3, s3h" for c in "xyz" for i, sign in ((0, "-"), (1, "+"))))
def frame_3d_sampled(spark, sf):
    """The frame of all rows beside the one of every tenth row, edge by edge."""
    df = points3(spark, sf)
    whole = frames.compute_frame_3d(df)
    tenth = frames.compute_frame_3d(frames.linspace_sample(df, whole.n_rows, whole.n_rows // 10))
    rows = [F.struct(F.lit(n).alias("edge"), F.round(F.lit(a), 9).alias("whole"), F.round(F.lit(b), 9).alias("sampled")) for n, a, b in zip(E3, whole.extent, tenth.extent)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("e")).select("e.*")


@query("linspace_sample", """
SELECT row_id, subset FROM p3 WHERE row_id IN (SELECT i * ((SELECT count(*) FROM p3) - 1) // 499 FROM range(500) t(i))""")
def linspace_sample(spark, sf):
    df = points3(spark, sf).select("row_id", "subset")
    return frames.linspace_sample(df, df.count(), 500)


@query("normalize", "SELECT row_id, round(px, 9) AS px, round(py, 9) AS py, round(pz, 9) AS pz FROM n3")
def normalize(spark, sf):
    out = frames.normalize(points3(spark, sf), frame3(spark, sf))
    return out.select("row_id", *[F.round(c, 9).alias(c) for c in ("px", "py", "pz")])


@query("normalize_queries", """
SELECT c_custkey AS q, round((c_acctbal / 50 - x0) / (x1 - x0) * 2.0::DOUBLE - 1.0::DOUBLE, 9) AS px,
       greatest(abs((c_acctbal / 50 - x0) / (x1 - x0) * 2.0::DOUBLE - 1.0::DOUBLE),
                abs((CAST(c_nationkey AS DOUBLE) * 4 - y0) / (y1 - y0) * 2.0::DOUBLE - 1.0::DOUBLE),
                abs((CAST(c_custkey AS DOUBLE) / 10 - z0) / (z1 - z0) * 2.0::DOUBLE - 1.0::DOUBLE)) > 1 AS outside_frame,
       false AS invalid
FROM customer, f3""")
def normalize_queries(spark, sf):
    q = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("q"), (F.col("c_acctbal") / 50).alias("x"),
        (F.col("c_nationkey").cast("double") * 4).alias("y"), (F.col("c_custkey").cast("double") / 10).alias("z"))
    out = frames.normalize_queries(q, frame3(spark, sf))
    return out.select("q", F.round("px", 9).alias("px"), "outside_frame", "invalid")


@query("voxel_bins", "SELECT row_id, vx, vy, vz FROM v3")
def voxel_bins(spark, sf):
    return frames.voxel_bins(frames.normalize(points3(spark, sf), frame3(spark, sf)), GRID).select("row_id", "vx", "vy", "vz")


@query("voxel_index", f"SELECT row_id, vx + {GRID} * (vy + {GRID} * vz) AS idx FROM v3")
def voxel_index(spark, sf):
    df = frames.voxel_bins(frames.normalize(points3(spark, sf), frame3(spark, sf)), GRID)
    return df.select("row_id", grid.flat_index(F.col("vx"), F.col("vy"), F.col("vz"), GRID).alias("idx"))


@query("chunk_id", "SELECT row_id, chunk_id FROM a3")
def chunk_id(spark, sf):
    return frames.assign_points(points3(spark, sf), frame3(spark, sf), GRID, VPC).select("row_id", "chunk_id")


@query("local_id", "SELECT row_id, local_id FROM a3")
def local_id(spark, sf):
    return frames.assign_points(points3(spark, sf), frame3(spark, sf), GRID, VPC).select("row_id", "local_id")


@query("assign_points", "SELECT row_id, chunk_id, local_id, vx, vy, vz FROM a3")
def assign_points(spark, sf):
    out = frames.assign_points(points3(spark, sf), frame3(spark, sf), GRID, VPC)
    return out.select("row_id", "chunk_id", "local_id", "vx", "vy", "vz")


@query("chunk_bbox", f"""
SELECT DISTINCT chunk_id, chunk_id % {G} AS cx, chunk_id // {G} % {G} AS cy, chunk_id // {G * G} AS cz,
  round((chunk_id % {G}) * {2 / G} - 1, 9)::DOUBLE AS x0, round((chunk_id % {G} + 1) * {2 / G} - 1, 9)::DOUBLE AS x1,
  round((chunk_id // {G} % {G}) * {2 / G} - 1, 9)::DOUBLE AS y0, round((chunk_id // {G} % {G} + 1) * {2 / G} - 1, 9)::DOUBLE AS y1,
  round((chunk_id // {G * G}) * {2 / G} - 1, 9)::DOUBLE AS z0, round((chunk_id // {G * G} + 1) * {2 / G} - 1, 9)::DOUBLE AS z1
FROM a3""")
def chunk_bbox(spark, sf):
    ids = frames.assign_points(points3(spark, sf), frame3(spark, sf), GRID, VPC).select("chunk_id").distinct()
    return frames.chunk_bbox(ids, G)


@query("voxel_center", f"""
SELECT DISTINCT chunk_id, local_id, (vx + 0.5::DOUBLE) * {2 / GRID}::DOUBLE - 1 AS wx, (vy + 0.5::DOUBLE) * {2 / GRID}::DOUBLE - 1 AS wy,
  (vz + 0.5::DOUBLE) * {2 / GRID}::DOUBLE - 1 AS wz FROM a3""")
def voxel_center(spark, sf):
    ids = frames.assign_points(points3(spark, sf), frame3(spark, sf), GRID, VPC).select("chunk_id", "local_id").distinct()
    return frames.voxel_center(ids, GRID, VPC)


@query("choose_max_zoom", """
SELECT t, n, CASE WHEN n <= 65536 THEN 0 WHEN n <= 262144 THEN 1 WHEN n <= 1048576 THEN 2 WHEN n <= 4194304 THEN 3
  WHEN n <= 16777216 THEN 4 ELSE 5 END::BIGINT AS max_zoom
FROM (SELECT 'lineitem' AS t, count(*) AS n FROM lineitem UNION ALL SELECT 'events', count(*) FROM events)""")
def choose_max_zoom(spark, sf):
    sizes = [(t, table(spark, sf, t).count()) for t in ("lineitem", "events")]
    return spark.createDataFrame([(t, n, grid.choose_max_zoom(n)) for t, n in sizes], "t string, n long, max_zoom long")


@query("nonfinite_rows", """
SELECT c_custkey, v FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal > 9000 THEN 'NaN'::DOUBLE
  ELSE c_acctbal END AS v FROM customer) WHERE v IS NULL OR isnan(v)""")
def nonfinite_rows(spark, sf):
    v = F.when(F.col("c_acctbal") < 0, None).when(F.col("c_acctbal") > 9000, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    df = table(spark, sf, "customer").select("c_custkey", v.alias("v"))
    return df.filter(frames.nonfinite(["v"]))
