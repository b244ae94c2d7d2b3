"""Blob packs of the document texts (shard = 64 documents), page urls as sidecar metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedmap.functions import codec
from embedmap.operators import blobs
from embedmap.plans.data import table
from embedmap.plans.registry import part, query


def payloads(spark, sf):
    """Text sizes by (shard, local); German texts stand in for missing payloads."""
    d = table(spark, sf, "documents")
    size = F.when(F.col("lang") != "de", F.octet_length("text")).cast("long")
    return d.select(F.shiftright("doc_id", 6).alias("shard"), (F.col("doc_id") % 64).alias("local"), size.alias("n_bytes"),
                    F.octet_length("text").cast("long").alias("source_bytes"), "lang", "doc_id")


part("pay", """
SELECT doc_id >> 6 AS shard, doc_id % 64 AS local, CASE WHEN lang <> 'de' THEN strlen(text) END AS n_bytes, strlen(text) AS source_bytes, lang, doc_id FROM documents""")
part("spn", """
SELECT shard, local, CAST(e - coalesce(n_bytes, 0) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM (
  SELECT *, sum(coalesce(n_bytes, 0)) OVER (PARTITION BY shard ORDER BY local) AS e FROM pay)""")
part("man", """SELECT shard, count(*) AS n_rows, max("end") AS n_bytes, (count(*) + 1) * 8 AS offset_bytes FROM spn GROUP BY 1""")


@query("pack_offsets", "SELECT * FROM spn")
def pack_offsets(spark, sf):
    return blobs.pack_offsets(payloads(spark, sf))


@query("lookup_spans", """
SELECT (event_id % 70) * 65536 + user_id AS ref, coalesce(start, 0) AS start, coalesce("end" - start, 0) AS length
FROM events LEFT JOIN spn ON shard = event_id % 70 AND local = user_id""")
def lookup_spans(spark, sf):
    """User ids are the local rows, and may exceed the 16 bits of a packed reference: the address is looked up, the number is its label."""
    refs = table(spark, sf, "events").select((F.col("event_id") % 70).alias("shard"), F.col("user_id").alias("local"))
    refs = refs.withColumn("ref", F.col("shard") * codec.REF_LOCALS + F.col("local"))
    return blobs.lookup_spans(blobs.pack_offsets(payloads(spark, sf)), refs)


@query("check_offsets", """
SELECT shard, 'span too large' AS problem FROM spn GROUP BY 1 HAVING max("end" - start) > 20000
UNION ALL SELECT shard, 'wrong row count' FROM man WHERE shard = 3""")
def check_offsets(spark, sf):
    offsets = blobs.pack_offsets(payloads(spark, sf))
    declared = blobs.shard_manifest(offsets).select(
        "shard", F.when(F.col("shard") == 3, F.col("n_rows") + 1).otherwise(F.col("n_rows")).alias("n_rows"), "n_bytes")
    return blobs.check_offsets(offsets, declared, 20000)


@query("shard_manifest", "SELECT * FROM man")
def shard_manifest(spark, sf):
    return blobs.shard_manifest(blobs.pack_offsets(payloads(spark, sf)))


@query("corpus_totals", """
SELECT count(*) AS n_shards, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(offset_bytes) AS BIGINT) AS offset_bytes FROM man""")
def corpus_totals(spark, sf):
    return blobs.corpus_totals(blobs.shard_manifest(blobs.pack_offsets(payloads(spark, sf))))


def receipts(spark, sf):
    d = table(spark, sf, "documents").select(F.shiftright("doc_id", 6).alias("shard"), (F.col("doc_id") % 64).alias("local"),
                                             F.col("text").cast("binary").alias("payload"), "lang")
    converted = d.withColumn("payload", F.when(F.col("lang") != "de", F.col("payload")))
    return blobs.build_receipts(d, converted, "build-1")


part("rcp", """
SELECT shard, count(*) AS n_rows, CAST(sum(source_bytes) AS BIGINT) AS source_bytes, count(*) FILTER (n_bytes > 0) AS n_valid,
  CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS target_bytes, count(*) - count(*) FILTER (n_bytes > 0) AS n_missing FROM pay GROUP BY 1""")


@query("build_receipts", "SELECT * FROM rcp")
def build_receipts(spark, sf):
    return receipts(spark, sf).drop("digest", "identity")


@query("pending_shards", "SELECT DISTINCT shard FROM pay WHERE shard NOT IN (SELECT shard FROM rcp WHERE n_missing > 8)")
def pending_shards(spark, sf):
    shards = payloads(spark, sf).select("shard").distinct()
    return blobs.pending_shards(shards, receipts(spark, sf).filter(F.col("n_missing") > 8), "build-1")


@query("release_progress", """
SELECT count(*) AS expected_shards, count(r.shard) AS completed_shards, CAST(sum(m.n_rows) AS BIGINT) AS expected_rows,
  CAST(sum(r.n_rows) AS BIGINT) AS completed_rows, CAST(sum(r.target_bytes) AS BIGINT) AS completed_bytes, count(*) = count(r.shard) AS complete, sum(r.target_bytes) > 1000000 AS over_ceiling
FROM man m LEFT JOIN (SELECT * FROM rcp WHERE n_missing <= 8) r ON r.shard = m.shard""")
def release_progress(spark, sf):
    manifest = blobs.shard_manifest(blobs.pack_offsets(payloads(spark, sf)))
    return blobs.release_progress(receipts(spark, sf).filter(F.col("n_missing") <= 8), manifest, 1000000)


def page_points(spark, sf):
    p = table(spark, sf, "pages")
    n = F.length("html").cast("long")
    url = F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 5 == 1, None).otherwise(F.col("url"))
    return p.select(F.col("page_id").alias("row_id"), url.alias("url"), (n * 20).alias("width"), (n - 2000).alias("height"))


part("pgs", """
SELECT page_id AS row_id, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE url END AS url,
  least(greatest(length(html) * 20, 0), 65535) AS width, least(greatest(length(html) - 2000, 0), 65535) AS height FROM pages""")
part("uml", """
SELECT row_id, url, CAST(coalesce(sum(coalesce(strlen(url), 0)) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS url_offset,
  coalesce(strlen(url), 0) AS url_len, width, height FROM pgs""")


@query("encode_urls", "SELECT row_id, coalesce(url, '') AS url, url_offset, url_len, width, height FROM uml")
def encode_urls(spark, sf):
    return blobs.encode_urls(page_points(spark, sf)).na.fill("", ["url"])


@query("lookup_meta", """
SELECT doc_id AS row_id, coalesce(url, 'none') AS url, coalesce(width, -1) AS width, coalesce(height, -1) AS height, doc_id < (SELECT count(*) FROM pages) AS in_range
FROM documents LEFT JOIN (SELECT row_id, nullif(url, '') AS url, width, height FROM pgs) ON row_id = doc_id""")
def lookup_meta(spark, sf):
    meta = blobs.encode_urls(page_points(spark, sf))
    out = blobs.lookup_meta(meta, table(spark, sf, "documents").select(F.col("doc_id").alias("row_id")), table(spark, sf, "pages").count())
    return out.na.fill("none", ["url"]).na.fill(-1, ["width", "height"])


@query("meta_summary", "SELECT count(*) AS n_rows, count(*) FILTER (url_len > 0) AS n_with_url, CAST(sum(url_len) AS BIGINT) AS url_bytes FROM uml")
def meta_summary(spark, sf):
    return blobs.meta_summary(blobs.encode_urls(page_points(spark, sf)))


@query("pilot_estimate", """
WITH s AS (SELECT shard FROM (SELECT DISTINCT shard FROM pay) ORDER BY md5('4:' || shard), shard LIMIT 3),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5('4:' || shard || ':' || local), local) AS k FROM pay WHERE shard IN (SELECT shard FROM s)) WHERE k <= 20)
SELECT count(*) AS n_sampled, CAST(sum(source_bytes) AS BIGINT) AS sample_source, CAST(sum(coalesce(n_bytes, 0)) AS BIGINT) AS sample_target,
  (SELECT CAST(sum(source_bytes) AS BIGINT) FROM pay) AS source_total, round(sum(n_bytes) / sum(source_bytes), 9) AS ratio,
  round(sum(n_bytes) / sum(source_bytes) * (SELECT sum(source_bytes) FROM pay), 3) AS estimate FROM t""")
def pilot_estimate(spark, sf):
    rows = payloads(spark, sf).select("shard", "local", "source_bytes", F.coalesce("n_bytes", F.lit(0)).alias("target_bytes"))
    out = blobs.pilot_estimate(rows, 3, 20, 4)
    return out.withColumn("ratio", F.round("ratio", 9)).withColumn("estimate", F.round("estimate", 3))


def subset_payloads(spark, sf):
    """Ids 0.. inside every language."""
    from embedmap.operators.ordering import id_bucket, rank_in_group

    d = table(spark, sf, "documents").select(F.col("lang").alias("subset"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return rank_in_group(d, ["subset"], ["doc_id"], "id", id_bucket("doc_id")).select("subset", "id", "n_bytes")


part("sub", "SELECT lang AS subset, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS id, strlen(text) AS n_bytes FROM documents")


@query("pack_subset_shards", """
SELECT subset, shard, id, CAST(sum(n_bytes) OVER (PARTITION BY subset, shard ORDER BY id) - n_bytes AS BIGINT) AS "offset", n_bytes AS length
FROM (SELECT *, id // 32 AS shard FROM sub)""")
def pack_subset_shards(spark, sf):
    return blobs.pack_subset_shards(subset_payloads(spark, sf), 32)


@query("dense_per_subset", """
SELECT lang AS subset, count(*) AS n_rows, min(doc_id) AS min_id, max(doc_id) AS max_id, count(DISTINCT doc_id) AS n_ids FROM documents GROUP BY 1""")
def dense_per_subset(spark, sf):
    return blobs.dense_per_subset(table(spark, sf, "documents").select(F.col("lang").alias("subset"), F.col("doc_id").alias("id")))


part("hrv", """
SELECT n_nationkey::BIGINT AS shard, coalesce(c, 0) AS "rows", coalesce(b, 0) AS bytes, coalesce(f, 0) AS failed, coalesce(u, 0) AS with_url, c IS NULL AS missing FROM nation LEFT JOIN (
  SELECT s_nationkey AS k, count(*) AS c, CAST(sum(strlen(s_name)) AS BIGINT) AS b, count(*) FILTER (s_acctbal < 0) AS f, count(*) FILTER (s_acctbal > 5000) AS u FROM supplier GROUP BY 1) ON k = n_nationkey""")


@query("harvest_manifest", "SELECT * FROM hrv")
def harvest_manifest(spark, sf):
    return _harvest(spark, sf)


def _harvest(spark, sf):
    got = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("shard")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("s_name")).alias("bytes"),
        F.count_if(F.col("s_acctbal") < 0).alias("failed"), F.count_if(F.col("s_acctbal") > 5000).alias("with_url"))
    return blobs.harvest_manifest(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("shard")), got)


@query("harvest_totals", """
SELECT count(*) AS n_shards, count(*) FILTER (missing) AS n_missing, CAST(sum("rows") AS BIGINT) AS "rows", CAST(sum(bytes) AS BIGINT) AS bytes,
  CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(with_url) AS BIGINT) AS with_url FROM hrv""")
def harvest_totals(spark, sf):
    return blobs.harvest_totals(_harvest(spark, sf))
