"""Metadata filters on the order points: type is the priority, book the customer, unknown year where status is P."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedmap.operators import metadata, voxels
from embedmap.plans.data import G, VPC, assigned, points3, table
from embedmap.plans.registry import part, query
from embedmap.sources import release

TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FILTER = {"type": "2-HIGH", "minYear": 1994, "maxYear": 1997, "includeUnknown": True}
STRICT = {"minYear": 1995}


def fname(key, order):
    return F.concat(F.lpad(F.col(key).cast("string"), 9, "0"), F.lit("_"), F.col(order).cast("string"), F.lit(".jpg"))


def images(spark, sf):
    o = table(spark, sf, "orders")
    points = o.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("subset"), F.col("o_orderkey").alias("local_idx"),
        fname("o_custkey", "o_orderkey").alias("fname"),
        F.when(F.col("o_orderstatus") == "P", "undated").otherwise(F.year("o_orderdate").cast("string")).alias("date"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_partkey").cast("string").alias("volume"), F.min("l_suppkey").cast("string").alias("page"))
    source = o.join(lines, "o_orderkey").select(
        fname("o_custkey", "o_orderkey").alias("fname"), F.col("o_orderpriority").alias("subset"), "volume", "page")
    placed = assigned(spark, sf)
    return metadata.build_images(points, voxels.postings(placed), source)


def books(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_name")).alias("title"),
        F.col("c_mktsegment").alias("author"), F.col("c_nationkey").cast("string").alias("publisher"), F.lit("").alias("place"))


part("img", """
SELECT p.row_id, o_orderpriority AS subset, p.row_id AS local_idx, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS book,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS year, p.chunk_id, p.local_id, p.pos,
  lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '_' || o_orderkey || '.jpg' AS fname, volume, page
FROM post p JOIN orders ON o_orderkey = p.row_id LEFT JOIN (
  SELECT l_orderkey, CAST(min(l_partkey) AS VARCHAR) AS volume, CAST(min(l_suppkey) AS VARCHAR) AS page FROM lineitem GROUP BY 1) ON l_orderkey = p.row_id""")
part("bks", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_name END AS title,
  c_mktsegment AS author, CAST(c_nationkey AS VARCHAR) AS publisher FROM customer""")
part("flt", "SELECT * FROM img WHERE subset = '2-HIGH' AND (year >= 1994 OR year IS NULL) AND (year <= 1997 OR year IS NULL)")
part("fcnt", "SELECT chunk_id, local_id, count(*) AS n FROM flt GROUP BY 1, 2")


def matching(spark, sf):
    return metadata.filter_rows(images(spark, sf), FILTER, TYPES)


@query("build_images", """
SELECT row_id, subset, local_idx, book, coalesce(year, -1) AS year, chunk_id, local_id, pos, fname, coalesce(volume, '') AS volume, coalesce(page, '') AS page FROM img""")
def build_images(spark, sf):
    return images(spark, sf).na.fill("", ["volume", "page"]).na.fill(-1, ["year"])


@query("filter_rows", "SELECT row_id, coalesce(year, -1) AS year FROM flt")
def filter_rows(spark, sf):
    return matching(spark, sf).select("row_id", F.coalesce("year", F.lit(-1)).alias("year"))


@query("filter_rows_strict", "SELECT row_id FROM img WHERE year >= 1995")
def filter_rows_strict(spark, sf):
    return metadata.filter_rows(images(spark, sf), STRICT, TYPES).select("row_id")


@query("filter_counts", "SELECT * FROM fcnt")
def filter_counts(spark, sf):
    return metadata.filter_counts(matching(spark, sf))


@query("row_mask", "SELECT row_id // 32768 AS bucket, count(*) AS bits FROM flt GROUP BY 1")
def row_mask(spark, sf):
    return metadata.row_mask(matching(spark, sf)).select("bucket", F.bitmap_count("mask").alias("bits"))


@query("mask_rows", "SELECT row_id FROM flt")
def mask_rows(spark, sf):
    return metadata.mask_rows(metadata.row_mask(matching(spark, sf)))


@query("filter_schema", "SELECT min(year) AS min_year, max(year) AS max_year, list_sort(list(DISTINCT subset)) AS options FROM img")
def filter_schema(spark, sf):
    return metadata.filter_schema(images(spark, sf))


part("det", """
SELECT i.*, coalesce(nullif(k.title, ''), i.fname) AS title,
  CASE WHEN nullif(k.title, '') IS NOT NULL THEN 'catalog title' ELSE 'source filename' END AS provenance, k.author, k.publisher
FROM img i LEFT JOIN bks k ON i.book = k.id""")


def detail(spark, sf):
    return metadata.image_detail(images(spark, sf), books(spark, sf), matching(spark, sf))


@query("image_detail", "SELECT row_id, title, provenance FROM det WHERE row_id IN (SELECT row_id FROM flt)")
def image_detail(spark, sf):
    return detail(spark, sf).select("row_id", "title", "provenance")


@query("image_fields", """
SELECT row_id, CAST(seq AS INTEGER) AS seq, label, value FROM (
  SELECT row_id, unnest([0, 1, 2, 3, 5, 6, 7]) AS seq,
    unnest(['Book ID', 'Author', 'Publication year (recorded)', 'Publisher', 'Volume', 'Page', 'Image type']) AS label,
    unnest([book, author, CAST(year AS VARCHAR), publisher, volume, page, subset]) AS value
  FROM det WHERE row_id IN (SELECT row_id FROM flt)) WHERE value IS NOT NULL AND value <> ''""")
def image_fields(spark, sf):
    return metadata.image_fields(detail(spark, sf))


@query("image_links", """
SELECT row_id, CAST(seq AS INTEGER) AS seq, label, url FROM (
  SELECT row_id, unnest([0, 1]) AS seq, unnest(['source row', 'photo page']) AS label,
    unnest(['https://host/' || subset || '/rows/' || local_idx, CASE WHEN length(fname) % 3 <> 0 THEN 'https://photos/' || fname END]) AS url
  FROM det WHERE row_id IN (SELECT row_id FROM flt)) WHERE url IS NOT NULL""")
def image_links(spark, sf):
    """Two thirds of the file names have a photo page."""
    d = detail(spark, sf)
    row_url = F.concat(F.lit("https://host/"), F.col("subset"), F.lit("/rows/"), F.col("local_idx").cast("string"))
    photo = F.when(F.length("fname") % 3 != 0, F.concat(F.lit("https://photos/"), F.col("fname"))).otherwise("")
    return metadata.image_links(d, row_url, d.select("fname", "subset", photo.alias("photo_url")).distinct())


@query("find_books", """
SELECT id, title FROM bks WHERE contains(lower(title), 'customer#00000012') AND id IN (SELECT book FROM img) """)
def find_books(spark, sf):
    return metadata.find_books(books(spark, sf), images(spark, sf), " cuSTomer#00000012 ")


@query("find_book_by_id", "SELECT DISTINCT img.book AS id, coalesce(k.title, img.book) AS title FROM img LEFT JOIN bks k ON k.id = img.book WHERE img.book = '000000057'")
def find_book_by_id(spark, sf):
    return metadata.find_books(books(spark, sf), images(spark, sf), "000000057")


@query("filtered_cells", f"""
SELECT chunk_id, 2::BIGINT AS step, local_id % {VPC} // 2 * 2 AS cell_x, local_id // {VPC} % {VPC} // 2 * 2 AS cell_y,
  local_id // {VPC * VPC} // 2 * 2 AS cell_z, CAST(sum(n) AS BIGINT) AS total, max(n) AS max_n, arg_min(local_id, -n * 4096 + local_id) AS best_local
FROM fcnt GROUP BY 1, 2, 3, 4, 5""")
def filtered_cells(spark, sf):
    return metadata.filtered_cells(metadata.filter_counts(matching(spark, sf)), VPC, 2)


@query("filtered_octree", f"""
WITH c AS (SELECT chunk_id % {G} AS cx, chunk_id // {G} % {G} AS cy, chunk_id // {G * G} AS cz, sum(n) AS n FROM fcnt GROUP BY chunk_id)
SELECT CAST(l AS BIGINT) AS level, cx >> l AS kx, cy >> l AS ky, cz >> l AS kz, CAST(sum(n) AS BIGINT) AS n_points, count(*) AS n_chunks
FROM c, (SELECT unnest([0, 1, 2]) AS l) GROUP BY 1, 2, 3, 4""")
def filtered_octree(spark, sf):
    return metadata.filtered_octree(metadata.filter_counts(matching(spark, sf)), G)


@query("check_snapshot", "SELECT count(*) AS bits, count(*) AS total, 0::BIGINT AS repeated, 0::BIGINT AS outside, true AS ok FROM flt")
def check_snapshot(spark, sf):
    m = matching(spark, sf)
    return metadata.check_snapshot(metadata.row_mask(m), metadata.filter_counts(m), table(spark, sf, "orders").count(), G**3, VPC)


def bound_artifacts(spark, sf):
    """Mask and counts bound to the digest of the points' manifest, and counts bound to a map that lacks a row."""
    points, m = points3(spark, sf), matching(spark, sf)
    mine = metadata.identity_of(release.release_manifest({"points": points}))
    other = metadata.identity_of(release.release_manifest({"points": points.filter("row_id > 0")}))
    mask, counts = metadata.row_mask(m), metadata.filter_counts(m)
    return mine, {"counts": metadata.bind(counts, mine), "foreign": metadata.bind(counts, other), "mask": metadata.bind(mask, mine)}


@query("check_snapshot_bound", "SELECT count(*) AS bits, count(*) AS total, 0::BIGINT AS repeated, 0::BIGINT AS outside, true AS ok FROM flt")
def check_snapshot_bound(spark, sf):
    """A snapshot whose mask and counts carry the identity of the map."""
    mine, bound = bound_artifacts(spark, sf)
    return metadata.check_snapshot(bound["mask"], bound["counts"], mine.rows, G**3, VPC, mine)


@query("foreign_rows", """
SELECT 'counts' AS artifact, count(*) AS n_rows, 0::BIGINT AS n_foreign FROM fcnt UNION ALL SELECT 'foreign', count(*), count(*) FROM fcnt
UNION ALL SELECT 'mask', count(DISTINCT row_id // 32768), 0 FROM flt""")
def foreign_rows(spark, sf):
    mine, bound = bound_artifacts(spark, sf)
    return metadata.foreign_rows(bound, mine)
