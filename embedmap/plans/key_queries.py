"""Keys, joins and identity on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedmap.functions import codec
from embedmap.operators import keys
from embedmap.operators.ordering import dense_row_id
from embedmap.plans.data import CORPORA, table
from embedmap.plans.registry import part, query


@query("dense_row_id", "SELECT l_id, row_number() OVER (ORDER BY ts, l_id) - 1 AS row_id FROM (SELECT event_id AS l_id, ts FROM events)")
def dense_id(spark, sf):
    ev = table(spark, sf, "events").select("ts", F.col("event_id").alias("l_id"))
    return dense_row_id(ev, ["ts", "l_id"]).select("l_id", "row_id")


@query("check_dense", """
SELECT count(*) AS n_rows, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key,
  count(*) - count(DISTINCT o_orderkey) AS n_duplicated,
  min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(DISTINCT o_orderkey) = count(*) AS dense FROM orders""")
def check_dense(spark, sf):
    return keys.check_dense(table(spark, sf, "orders"), "o_orderkey")


@query("check_dense_broken", """
SELECT CAST(sum(c) AS BIGINT) AS n_rows, min(k) AS min_key, max(k) AS max_key, count(*) FILTER (c > 1) AS n_duplicated, false AS dense
FROM (SELECT l_orderkey AS k, count(*) AS c FROM lineitem GROUP BY 1)""")
def check_dense_broken(spark, sf):
    return keys.check_dense(table(spark, sf, "lineitem"), "l_orderkey")


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return keys.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("one_to_one_join", """
SELECT doc_id, lang, n_chars, length(t) AS n FROM documents JOIN (SELECT doc_id, text AS t FROM documents) USING (doc_id)""")
def one_to_one_join(spark, sf):
    d = table(spark, sf, "documents")
    right = d.select("doc_id", F.length("text").alias("n"))
    return keys.one_to_one_join(d.select("doc_id", "lang", "n_chars"), right, ["doc_id"]).withColumn("n", F.col("n").cast("long"))


@query("one_to_one_report", """
WITH l AS (SELECT doc_id AS k, 1::BIGINT AS c FROM documents), r AS (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1)
SELECT k, 'duplicate right' AS problem FROM r WHERE c > 1
UNION ALL SELECT k, 'left only' FROM l WHERE k NOT IN (SELECT k FROM r)
UNION ALL SELECT k, 'right only' FROM r WHERE k NOT IN (SELECT k FROM l)""")
def one_to_one_report(spark, sf):
    left = table(spark, sf, "documents").select(F.col("doc_id").alias("k"))
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return keys.one_to_one_report(left, right, ["k"])


@query("enrich_left", """
SELECT doc_id AS k, source, CASE WHEN url = '' THEN NULL ELSE url END AS url, greatest(0, coalesce(w, 0)) AS width,
  greatest(0, coalesce(w, 0) - 100) AS height
FROM documents LEFT JOIN (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS url, length(html) - 500 AS w FROM pages)
  ON page_id = doc_id""")
def enrich_left(spark, sf):
    points = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), "source")
    w = F.length("html").cast("long") - 500
    lookup = table(spark, sf, "pages").select(
        F.col("page_id").alias("k"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("url"),
        w.alias("width"), (w - 100).alias("height"))
    return keys.enrich_left(points, lookup, ["k"])


CODE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CORPORA.items()) + " END::BIGINT"


@query("encode_subset", f"SELECT event_id, {CODE} AS code FROM events")
def encode_subset(spark, sf):
    return keys.encode_subset(table(spark, sf, "events"), "event_type", CORPORA).select("event_id", "code")


@query("unknown_values", "SELECT event_type, count(*) AS n_rows FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1")
def unknown_values(spark, sf):
    known = {k: v for k, v in CORPORA.items() if k not in ("signup", "view")}
    return keys.unknown_values(table(spark, sf, "events"), "event_type", known)


@query("pack_ref", """
SELECT conv_id, turn, conv_id * 65536 + turn AS ref, conv_id AS shard, turn AS local FROM conversations""")
def pack_ref(spark, sf):
    ref = codec.pack_ref(F.col("conv_id"), F.col("turn"))
    df = table(spark, sf, "conversations").select("conv_id", "turn", ref.alias("ref"))
    shard, local = codec.unpack_ref(F.col("ref"))
    return df.withColumns({"shard": shard, "local": local})


@query("ref_violations", "SELECT conv_id, turn * 10000 AS local FROM conversations WHERE turn * 10000 > 65535")
def ref_violations(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", (F.col("turn") * 10000).alias("local"))
    return keys.ref_violations(df, "conv_id", "local")


@query("pack_point", f"SELECT event_id, {CODE} * 268435456 + event_id AS packed, {CODE} AS corpus, event_id AS row_id FROM events")
def pack_point(spark, sf):
    df = keys.encode_subset(table(spark, sf, "events"), "event_type", CORPORA)
    df = df.select("event_id", codec.pack_point(F.col("code"), F.col("event_id")).alias("packed"))
    corpus, row = codec.unpack_point(F.col("packed"))
    return df.withColumns({"corpus": corpus, "row_id": row})


@query("pack_voxel", "SELECT p_partkey, p_partkey * 4096 + p_size AS packed, p_partkey AS chunk_id, CAST(p_size AS BIGINT) AS local_id FROM part")
def pack_voxel(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", codec.pack_voxel(F.col("p_partkey"), F.col("p_size")).alias("packed"))
    chunk, local = codec.unpack_voxel(F.col("packed"))
    return df.withColumns({"chunk_id": chunk, "local_id": local})


# Draw: every part is a drawn pool row (orders is the pool).
@query("select_draw", """
SELECT p_partkey AS row_id, p_partkey * 3 + p_size // 20 AS pool_row, o_orderpriority, o_totalprice
FROM part JOIN orders ON o_orderkey = p_partkey * 3 + p_size // 20""")
def select_draw(spark, sf):
    idx = _draw(spark, sf)
    pool = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pool_row"), "o_orderpriority", "o_totalprice")
    return keys.select_draw(pool, idx)


def _draw(spark, sf):
    row = F.col("p_partkey") * 3 + F.expr("p_size div 20")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), row.alias("pool_row"))


@query("draw_violations", """
SELECT row_id, pool_row, previous FROM (SELECT p_partkey AS row_id, p_partkey + p_size AS pool_row,
  lag(p_partkey + p_size) OVER (ORDER BY p_partkey) AS previous FROM part) WHERE pool_row <= previous""")
def draw_violations(spark, sf):
    idx = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") + F.col("p_size")).alias("pool_row"))
    return keys.draw_violations(idx)


# (shard, local_row) addressing: conversations are the store, events the referring points.
part("conv_refs", """
SELECT event_id AS row_id, user_id AS shard, event_id % 8 AS local_row FROM events""")


def _conv_refs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("shard"), (F.col("event_id") % 8).alias("local_row"))


@query("gather_by_ref", """
SELECT p.*, 'conv/' || shard || '/' || local_row AS url, CAST(length(text) AS BIGINT) AS width, CAST(length(role) AS BIGINT) AS height
FROM conv_refs p JOIN conversations ON conv_id = shard AND turn = local_row""")
def gather_by_ref(spark, sf):
    refs, store = _conv_refs(spark, sf), _conv_store(spark, sf)
    return keys.gather_by_ref(refs.join(store, ["shard", "local_row"], "left_semi"), store)


def _conv_store(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("shard"), F.col("turn").alias("local_row"),
        F.concat_ws("/", F.lit("conv"), "conv_id", "turn").alias("url"),
        F.length("text").cast("long").alias("width"), F.length("role").cast("long").alias("height"))


@query("unmatched_refs", """
SELECT p.* FROM conv_refs p WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE conv_id = shard AND turn = local_row)""")
def unmatched_refs(spark, sf):
    """References that gathering refuses."""
    return keys.unmatched(_conv_refs(spark, sf), _conv_store(spark, sf), ["shard", "local_row"])


@query("missing_refs", """
SELECT row_id, shard, local_row, CASE WHEN n_rows IS NULL THEN 'missing shard' ELSE 'row beyond shard' END AS problem
FROM conv_refs LEFT JOIN (SELECT conv_id, max(turn) + 1 AS n_rows FROM conversations GROUP BY 1) ON conv_id = shard
WHERE n_rows IS NULL OR local_row >= n_rows""")
def missing_refs(spark, sf):
    sizes = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("shard")).agg((F.max("turn") + 1).alias("n_rows"))
    return keys.missing_refs(_conv_refs(spark, sf), sizes).drop("n_rows")


# Training rows name shard path and local row; the pool stores shard numbers. Toxic documents carry a wrong id.
@query("provenance_join", """
SELECT d.doc_id AS row_id, d.doc_id AS pool_row, coalesce(l.toxic, 0) = 0 AS agrees FROM documents d LEFT JOIN labels l USING (doc_id)""")
def provenance_join(spark, sf):
    return _provenance(spark, sf)


def _provenance(spark, sf):
    d = table(spark, sf, "documents")
    shard = F.substring("source", 4, 9).cast("long")
    pool = d.select(F.col("doc_id").alias("pool_row"), shard.alias("shard"), F.col("doc_id").alias("local_row"),
                    F.md5(F.col("text").cast("binary")).alias("pool_id"))
    paths = d.select(shard.alias("shard"), F.concat(F.lit("pool/"), F.col("source")).alias("path")).distinct()
    marked = d.join(table(spark, sf, "labels"), "doc_id", "left")
    image_id = F.when(F.coalesce("toxic", F.lit(0)) == 0, F.md5(F.col("text").cast("binary"))).otherwise("other")
    training = marked.select(F.col("doc_id").alias("row_id"), F.concat(F.lit("pool/"), F.col("source")).alias("path"),
                             F.col("doc_id").alias("local_row"), image_id.alias("image_id"))
    return keys.provenance_join(training, pool, paths)


@query("provenance_violations", "SELECT doc_id AS row_id, doc_id AS pool_row, 'id mismatch' AS problem FROM labels WHERE toxic = 1")
def provenance_violations(spark, sf):
    return keys.provenance_violations(_provenance(spark, sf))


@query("map_source_rows", """
WITH s AS (SELECT o_custkey AS shard, count(*) AS n_rows, min(o_orderstatus) AS shard_category FROM orders GROUP BY 1),
t AS (SELECT *, coalesce(sum(n_rows) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_row FROM s)
SELECT o_orderkey AS row_id, o_custkey AS shard, o_orderkey % 12 AS local_row, o_orderstatus AS category,
  CAST(first_row + o_orderkey % 12 AS BIGINT) AS source_row, o_orderkey % 12 < n_rows AND o_orderstatus = shard_category AS valid
FROM orders JOIN t ON shard = o_custkey""")
def map_source_rows(spark, sf):
    from embedmap.operators.ordering import running_total, id_bucket

    o = table(spark, sf, "orders")
    stats = o.groupBy(F.col("o_custkey").alias("shard")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderstatus").alias("shard_category"))
    stats = running_total(stats, [], ["shard"], F.col("n_rows"), "first_row", id_bucket("shard", 9))
    refs = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("shard"),
                    (F.col("o_orderkey") % 12).alias("local_row"), F.col("o_orderstatus").alias("category"))
    return keys.map_source_rows(refs, stats)


@query("concat_corpora", """
SELECT doc_id AS row_id, text AS body FROM documents UNION ALL
SELECT page_id + (SELECT count(*) FROM documents), html FROM pages UNION ALL
SELECT item_id + (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages), text FROM benchmark""")
def concat_corpora(spark, sf):
    parts = [table(spark, sf, t).select(F.col(i).alias("row_id"), F.col(b).alias("body"))
             for t, i, b in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text"))]
    return keys.concat_corpora([(p, p.count()) for p in parts])


@query("extend_metadata", """
SELECT doc_id AS row_id, url, CAST(coalesce(length(url), 0) AS BIGINT) AS url_len, CAST(coalesce(length(html), 0) AS BIGINT) AS width,
  CAST(coalesce(length(url), 0) AS BIGINT) AS height FROM documents LEFT JOIN pages ON page_id = doc_id""")
def extend_metadata(spark, sf):
    ul = F.length("url").cast("long")
    meta = table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), "url", ul.alias("url_len"),
                                            F.length("html").cast("long").alias("width"), ul.alias("height"))
    return keys.extend_metadata(meta, table(spark, sf, "documents").count())


# Identity: documents with the digest of their text as perceptual hash; copies collide. ANN ids run backwards.
part("ident", "SELECT doc_id AS row_id, md5(text) AS hash FROM documents")
part("anns", "SELECT (SELECT max(doc_id) FROM documents) - doc_id AS ann_id, md5(text) AS hash, md5(source || lang) AS code FROM documents")


def _identity(spark, sf):
    d = table(spark, sf, "documents")
    digest = F.md5(F.col("text").cast("binary"))
    shard = F.substring("source", 4, 9).cast("long")
    image = F.col("doc_id").cast("string")
    rows = d.select(F.col("doc_id").alias("row_id"), shard.alias("shard"), image.alias("image_id"))
    paths = d.select(shard.alias("shard"), F.concat(F.lit("v1.2.0/"), F.col("source")).alias("path")).distinct()
    catalog = d.select(F.col("source").alias("path"), image.alias("image_id"), digest.alias("hash"))
    return keys.identity_rows(rows, paths, catalog)


def _ann(spark, sf):
    d = table(spark, sf, "documents")
    last = d.agg(F.max("doc_id")).first()[0]
    return d.select((F.lit(last) - F.col("doc_id")).alias("ann_id"), F.md5(F.col("text").cast("binary")).alias("hash"),
                    F.md5(F.concat("source", "lang").cast("binary")).alias("code"))


@query("identity_rows", "SELECT * FROM ident")
def identity_rows(spark, sf):
    return _identity(spark, sf)


@query("unmatched_identity", """
SELECT doc_id AS id, 'ann' AS side FROM documents WHERE lang = 'de' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang <> 'de')
UNION ALL SELECT doc_id, 'row' FROM documents WHERE lang = 'de'""")
def unmatched_identity(spark, sf):
    d = table(spark, sf, "documents")
    digest = F.md5(F.col("text").cast("binary"))
    rows = d.select(F.col("doc_id").alias("row_id"), F.when(F.col("lang") != "de", digest).alias("hash"))
    return keys.unmatched_identity(rows, d.select(F.col("doc_id").alias("ann_id"), digest.alias("hash")))


part("cmap", """
SELECT ann_id, hash, CASE WHEN n = 1 THEN first ELSE -1 END AS row_id, n AS n_candidates
FROM anns JOIN (SELECT hash, count(*) AS n, min(row_id) AS first FROM ident GROUP BY 1) USING (hash)""")


@query("collision_map", "SELECT * FROM cmap")
def collision_map(spark, sf):
    return keys.collision_map(_identity(spark, sf), _ann(spark, sf).drop("code"))


@query("collision_candidates", "SELECT hash, row_id FROM ident WHERE hash IN (SELECT hash FROM ident GROUP BY 1 HAVING count(*) > 1)")
def collision_candidates(spark, sf):
    return keys.collision_candidates(_identity(spark, sf))


@query("resolve_collisions", """
WITH rows_by AS (SELECT md5(text) AS hash, md5(source || lang) AS code, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2)
SELECT a.ann_id, CASE WHEN r.n = 1 THEN r.first ELSE -1 END AS row_id, coalesce(r.n, 0) AS n_matches,
  CASE WHEN r.n = 1 THEN 'resolved' WHEN r.n IS NULL THEN 'no match' ELSE 'unresolved' END AS status
FROM cmap m JOIN anns a USING (ann_id) LEFT JOIN rows_by r ON r.hash = a.hash AND r.code = a.code
WHERE m.n_candidates > 1""")
def resolve_collisions(spark, sf):
    rows, ann = _identity(spark, sf), _ann(spark, sf)
    codes = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.md5(F.concat("source", "lang").cast("binary")).alias("code"))
    return keys.resolve_collisions(keys.collision_map(rows, ann.drop("code")), keys.collision_candidates(rows),
                                   ann.select("ann_id", "code"), codes)


@query("check_permutation", """
SELECT 'ann_id' AS key, count(*) AS n_rows, min(ann_id) AS min_key, max(ann_id) AS max_key, 0::BIGINT AS n_duplicated, true AS dense FROM cmap
UNION ALL SELECT 'row_id', (SELECT count(*) FROM cmap), min(row_id), max(row_id), count(*) FILTER (c > 1), false
FROM (SELECT row_id, count(*) AS c FROM cmap GROUP BY 1)""")
def check_permutation(spark, sf):
    return keys.check_permutation(keys.collision_map(_identity(spark, sf), _ann(spark, sf).drop("code")), "ann_id", "row_id")


@query("verify_row_order", """
WITH s AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY 1),
t AS (SELECT *, coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
p AS (SELECT CAST(start + turn AS BIGINT) AS row_id, conv_id, CASE WHEN role = 'user' AND turn > 3 THEN turn + 1 ELSE turn END AS l FROM conversations JOIN t USING (conv_id))
SELECT row_id, conv_id * 65536 + l AS ref FROM p JOIN t USING (conv_id) WHERE l >= n OR start + l <> row_id""")
def verify_row_order(spark, sf):
    """Some references are moved by one row on purpose."""
    from pyspark.sql.window import Window

    c = table(spark, sf, "conversations")
    shards = c.groupBy(F.col("conv_id").alias("shard")).agg((F.max("turn") + 1).alias("n_rows")).withColumn("seq", F.col("shard"))
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.withColumn("start", F.coalesce(F.sum("n_rows").over(w), F.lit(0)))
    local = F.when((F.col("role") == "user") & (F.col("turn") > 3), F.col("turn") + 1).otherwise(F.col("turn"))
    points = c.join(starts, F.col("conv_id") == F.col("shard")).select(
        (F.col("start") + F.col("turn")).alias("row_id"), codec.pack_ref(F.col("conv_id"), local).alias("ref"))
    return keys.verify_row_order(points, shards)


part("sampled", """
SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS k FROM embeddings) WHERE k <= 5""")


@query("stratified_sample", "SELECT vec_id, label FROM sampled")
def stratified_sample(spark, sf):
    return keys.stratified_sample(table(spark, sf, "embeddings").select("vec_id", "label"), "label", 5, 7, "vec_id")


@query("training_sample", """
SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM sampled) ORDER BY md5('8:' || vec_id), vec_id LIMIT 200""")
def training_sample(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return keys.training_sample(e.select("vec_id"), keys.stratified_sample(e, "label", 5, 7, "vec_id"), 200, 8, "vec_id")
