"""Readers, rebuild contract and manifests on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedmap.plans.data import table
from embedmap.plans.registry import query
from embedmap.sources import release, tables


@query("read_points", "SELECT o_orderkey, o_orderpriority FROM orders")
def read_points(spark, sf):
    return tables.read_points(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderpriority"])


@query("read_manifest_set", """
SELECT doc_id AS id, text AS body, 'plates' AS subset FROM documents UNION ALL SELECT item_id, text, 'covers' FROM benchmark""")
def read_manifest_set(spark, sf):
    docs = tables.read_manifest_set(spark, {"plates": f"{sf}/documents.parquet"}, ["doc_id", "text"]).withColumnRenamed("doc_id", "id")
    bench = tables.read_manifest_set(spark, {"covers": f"{sf}/benchmark.parquet"}, ["item_id", "text"]).withColumnRenamed("item_id", "id")
    return docs.unionByName(bench).select("id", F.col("text").alias("body"), "subset")


def catalog_rows(spark, sf):
    return table(spark, sf, "part").select(
        (F.col("p_partkey") % 500).cast("string").alias("id"), F.col("p_brand").alias("title"), F.col("p_type").alias("author"),
        F.col("p_name").alias("publisher"))


@query("build_catalog", """
SELECT lpad(id, 9, '0') AS id, title, author, publisher FROM (
  SELECT CAST(p_partkey % 500 AS VARCHAR) AS id, p_brand AS title, p_type AS author, p_name AS publisher,
    row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_brand, p_type, p_name) AS k FROM part) WHERE k = 1""")
def build_catalog(spark, sf):
    return tables.build_catalog(catalog_rows(spark, sf), conflicts="smallest")


@query("build_catalog_checked", """
SELECT lpad(CAST(p_partkey % 500 AS VARCHAR), 9, '0') AS id, 'Book ' || (p_partkey % 500) AS title, min(p_type) AS author, arg_min(p_name, p_type || p_name) AS publisher
FROM part GROUP BY p_partkey % 500""")
def build_catalog_checked(spark, sf):
    """Repeated rows whose titles agree; others would stop the read."""
    rows = catalog_rows(spark, sf).withColumn("title", F.concat(F.lit("Book "), F.col("id")))
    return tables.build_catalog(rows)


@query("catalog_conflicts", """
SELECT lpad(CAST(p_partkey % 500 AS VARCHAR), 9, '0') AS id, min(p_brand) AS first_title, max(p_brand) AS last_title FROM part GROUP BY 1
HAVING count(DISTINCT p_brand) > 1""")
def catalog_conflicts(spark, sf):
    return tables.catalog_conflicts(catalog_rows(spark, sf))


@query("harvest_columns", """
SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN 'none' ELSE c_mktsegment END AS url,
  CASE WHEN c_acctbal < 0 THEN 0 ELSE least(CAST(floor(c_acctbal * 10) AS BIGINT), 65535) END AS width, 0::BIGINT AS height FROM customer""")
def harvest_columns(spark, sf):
    """Empty urls, NaN and oversize widths, no height column at all."""
    shard = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("url"),
        F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal") * 10).alias("width"))
    return tables.harvest_columns(shard).na.fill("none", ["url"])


@query("contract_diff", """
WITH d AS (SELECT o_orderkey AS k, o_orderstatus = 'P' AND o_orderkey > 5 AS a, o_orderkey >= (SELECT count(*) - 7 FROM orders) AS gone FROM orders)
SELECT 'subset' AS "column", count(*) FILTER (a OR gone) AS n_differing, min(k) FILTER (a OR gone) AS first_row FROM d
UNION ALL SELECT 'global_idx', count(*) FILTER (gone), min(k) FILTER (gone) FROM d""")
def contract_diff(spark, sf):
    """A rebuild that changes some cells and lacks the last seven rows."""
    o = table(spark, sf, "orders")
    n = o.count()
    old = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("subset"), F.col("o_custkey").alias("global_idx"), "o_orderstatus")
    changed = (F.col("o_orderstatus") == "P") & (F.col("row_id") > 5)
    new = old.filter(F.col("row_id") < n - 7).withColumn("subset", F.when(changed, "other").otherwise(F.col("subset")))
    return release.contract_diff(new, old, ["subset", "global_idx"])


@query("release_manifest", """
SELECT 'nation' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def release_manifest(spark, sf):
    return release.release_manifest({t: table(spark, sf, t) for t in ("nation", "orders", "lineitem")}).select("name", "n_rows")


@query("release_manifest_bytes", """
SELECT 'documents' AS name, count(*) AS n_rows,
  CAST(sum(CASE WHEN doc_id IS NULL THEN 0 ELSE 8 END + CASE WHEN n_chars IS NULL THEN 0 ELSE 8 END + coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0)) AS BIGINT) AS n_bytes
FROM documents UNION ALL
SELECT 'customer', count(*), CAST(sum(CASE WHEN c_custkey IS NULL THEN 0 ELSE 8 END + CASE WHEN c_acctbal IS NULL THEN 0 ELSE 8 END) + sum(coalesce(strlen(c_mktsegment), 0)) AS BIGINT) FROM customer""")
def release_manifest_bytes(spark, sf):
    """Rows and stored bytes of two tables."""
    picked = {"documents": table(spark, sf, "documents"), "customer": table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")}
    return release.release_manifest(picked).select("name", "n_rows", "n_bytes")


@query("validate_release", """
SELECT 'orders' AS name, unnest(['rows', 'bytes', 'digest']) AS problem UNION ALL SELECT 'part', 'unknown table' UNION ALL SELECT 'nation', 'missing table'""")
def validate_release(spark, sf):
    """Against a manifest taken earlier: one table has lost rows, one is gone, one is new."""
    before = release.release_manifest({t: table(spark, sf, t) for t in ("nation", "orders", "customer")})
    now = {"orders": table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P"), "customer": table(spark, sf, "customer"), "part": table(spark, sf, "part")}
    return release.validate_release(before, now)
