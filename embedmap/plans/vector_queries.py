"""Vector search and evaluation on the embeddings table; queries are the label centroids."""

from __future__ import annotations

import time
import uuid

import numpy as np
from pyspark.sql import functions as F

from embedmap.functions import vectors as vf
from embedmap.operators import ann, blocks, keys, vectors
from embedmap.operators.frames import linspace_sample
from embedmap.plans.data import table
from embedmap.plans.registry import part, query
from embedmap.session import ensure_checkpoint_dir

K = 24


def base(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", F.col("label").cast("long").alias("label"))


def centroids(spark, sf):
    """Unit centroid of every label, as query vectors."""
    long = base(spark, sf).select("label", F.posexplode(vf.as_double(F.col("embedding"))).alias("dim", "v"))
    mean = long.groupBy("label", "dim").agg(F.avg("v").alias("v"))
    vec = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("e"))
    out = vec.select(F.col("label").alias("q"), F.transform("e", lambda s: s["v"]).alias("embedding"))
    return vectors.l2_normalize(out)


def held_out(spark, sf):
    """Seeded rows of every label as image queries."""
    return keys.stratified_sample(base(spark, sf), "label", 2, 3).select(F.col("row_id").alias("q"), vf.as_double(F.col("embedding")).alias("embedding"))


part("emb", "SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")
part("dims", "SELECT row_id, label, unnest(e) AS v, unnest(range(len(e))) AS dim FROM emb")
part("cent", """
SELECT q, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM (
  SELECT label AS q, list(v ORDER BY dim) AS e FROM (SELECT label, dim, avg(v) AS v FROM dims GROUP BY 1, 2) GROUP BY 1)""")
part("ipt", "SELECT q, row_id, round(list_inner_product(emb.e, cent.e), 6) AS score FROM emb, cent")
part("knnt", f"""
SELECT * FROM (SELECT q, row_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS rank FROM ipt) WHERE rank <= {K}""")


@query("l2_normalize", """
SELECT row_id, round(list_inner_product(e, e), 6) AS norm2, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first FROM emb""")
def l2_normalize(spark, sf):
    out = vectors.l2_normalize(base(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(3.0))))
    raw = base(spark, sf).select("row_id", F.round(vf.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"))
    return out.select("row_id", F.round(F.col("embedding")[0], 6).alias("first")).join(raw, "row_id")


@query("invalid_vectors", "SELECT row_id FROM emb WHERE label = 3")
def invalid_vectors(spark, sf):
    broken = F.when(F.col("label") == 3, F.transform("embedding", lambda x: x * F.lit(0.0))).otherwise(F.col("embedding"))
    return vectors.invalid_vectors(base(spark, sf).withColumn("embedding", broken)).select("row_id")


@query("knn_exact", "SELECT * FROM knnt")
def knn_exact(spark, sf):
    return vectors.knn_exact(base(spark, sf), centroids(spark, sf), K)


@query("knn_cosine", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS rank FROM (SELECT q, row_id, round(list_cosine_similarity(emb.e, cent.e), 6) AS score FROM emb, cent)) WHERE rank <= 24")
def knn_cosine(spark, sf):
    return vectors.knn_exact(base(spark, sf), centroids(spark, sf), K, "cosine")


@query("knn_l2", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS rank FROM (SELECT q, row_id, round(-list_sum(list_transform(list_zip(emb.e, cent.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS score FROM emb, cent)) WHERE rank <= 24")
def knn_l2(spark, sf):
    return vectors.knn_exact(base(spark, sf), centroids(spark, sf), K, "l2")


LISTS, NPROBE = 8, 3
#: Trained lists and probes: the smallest share of lists with a recall of at least 0.9 on these vectors, whose neighbours lie in many lists.
TRAINED_LISTS, TRAINED_NPROBE = 16, 12


def ivf(spark, sf):
    """Lists around seeded rows, so that assignment and probing can be checked; training is tested apart."""
    b = base(spark, sf)
    model = ann.Ivf(ann.seeded_rows(b, LISTS, 1))
    return model, ann.ivf_assign(b, model)


def ivf_trained(spark, sf):
    """Lists by k-means over the whole table. k-means has no SQL form: tests hold the searches against brute force."""
    b = base(spark, sf)
    model = ann.ivf_train(b, TRAINED_LISTS, seed=1)
    return model, ann.ivf_assign(b, model)


def probe_queries(spark, sf):
    """Every fiftieth row as an image query."""
    return base(spark, sf).filter("row_id % 50 = 0").select(F.col("row_id").alias("q"), vf.as_double(F.col("embedding")).alias("embedding"))


part("ivc", f"SELECT list_id, e FROM (SELECT row_number() OVER (ORDER BY md5('1:' || row_id), row_id) - 1 AS list_id, e FROM emb) WHERE list_id < {LISTS}")
part("ivd", "SELECT row_id, list_id, list_inner_product(ivc.e, ivc.e) - 2 * list_inner_product(emb.e, ivc.e) AS d FROM emb, ivc")
part("iva", "SELECT row_id, list_id FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, list_id) AS k FROM ivd) WHERE k = 1")
part("ivq", "SELECT row_id AS q, e FROM emb WHERE row_id % 50 = 0")
part("ivs", "SELECT ivq.q, emb.row_id, round(list_inner_product(emb.e, ivq.e), 6) AS score FROM emb, ivq")
part("ivt", f"SELECT q, row_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS k FROM ivs) WHERE k <= {K}")
part("ivp", f"SELECT row_id AS q, list_id FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, list_id) AS k FROM ivd WHERE row_id % 50 = 0) WHERE k <= {NPROBE}")
part("ivf", f"""
SELECT q, row_id, score, rank FROM (SELECT ivs.*, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS rank
  FROM ivs JOIN iva USING (row_id) JOIN ivp USING (q, list_id)) WHERE rank <= {K}""")


@query("ivf_assign", "SELECT row_id, list_id FROM iva")
def ivf_assign(spark, sf):
    return ivf(spark, sf)[1].select("row_id", "list_id")


@query("ivf_search_all_lists", "SELECT * FROM knnt")
def ivf_search_all_lists(spark, sf):
    """All lists of the trained index, which give the exact answer."""
    model, index = ivf_trained(spark, sf)
    return ann.ivf_search(index, model, centroids(spark, sf), K, nprobe=TRAINED_LISTS)


@query("ivf_search", "SELECT * FROM ivf")
def ivf_search(spark, sf):
    model, index = ivf(spark, sf)
    return ann.ivf_search(index, model, probe_queries(spark, sf), K, NPROBE)


@query("ivf_search_recall", f"""
SELECT count(*) AS n_queries, round(avg(r), 9) AS recall FROM (
  SELECT q, (SELECT count(*) FROM ivt t JOIN ivf f USING (q, row_id) WHERE t.q = ivq.q) / {K}.0::DOUBLE AS r FROM ivq)""")
def ivf_search_recall(spark, sf):
    model, index = ivf(spark, sf)
    q = probe_queries(spark, sf)
    truth = vectors.knn_exact(base(spark, sf), q, K)
    return vectors.recall_at_k(ann.ivf_search(index, model, q, K, NPROBE), truth, K).withColumn("recall", F.round("recall", 9))


@query("ivf_assign_trained")
def ivf_assign_trained(spark, sf):
    return ivf_trained(spark, sf)[1].select("row_id", "list_id")


@query("ivf_search_trained")
def ivf_search_trained(spark, sf):
    model, index = ivf_trained(spark, sf)
    return ann.ivf_search(index, model, probe_queries(spark, sf), K, TRAINED_NPROBE)


@query("ivf_search_recall_trained")
def ivf_search_recall_trained(spark, sf):
    """Recall of the trained index against the exact search."""
    truth = vectors.knn_exact(base(spark, sf), probe_queries(spark, sf), K)
    return vectors.recall_at_k(ivf_search_trained(spark, sf), truth, K)


@query("knn_every_fiftieth", f"""
SELECT * FROM (SELECT q, row_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS rank FROM ivs) WHERE rank <= {K}""")
def knn_every_fiftieth(spark, sf):
    """Exact search of every fiftieth row over stored blocks of vectors."""
    path = f"{ensure_checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
    blocks.write(vectors.vector_blocks(base(spark, sf)), path)
    return vectors.knn_blocks(spark.read.parquet(path), probe_queries(spark, sf), K)


def stored_lists(spark, sf):
    """Model and stored index of residual codes, trained on the whole table."""
    b = base(spark, sf)
    model = ann.train_codes(b, ann.ivf_train(b, TRAINED_LISTS, seed=1))
    path = f"{ensure_checkpoint_dir(spark)}/lists-{uuid.uuid4().hex}"
    ann.write_lists(ann.code_blocks(b, model), path)
    return model, ann.read_lists(spark, path)


@query("ivf_codes_all_lists", "SELECT * FROM knnt")
def ivf_codes_all_lists(spark, sf):
    """Codes of all stored lists, rescored as far as their error reaches, give the exact answer."""
    model, lists = stored_lists(spark, sf)
    q = centroids(spark, sf)
    return ann.search_lists_exact(lists, model, base(spark, sf), q, K)


@query("ivf_codes_search")
def ivf_codes_search(spark, sf):
    """Every fiftieth row in the stored lists of codes, rescored."""
    model, lists = stored_lists(spark, sf)
    q = probe_queries(spark, sf)
    return ann.refine(ann.search_lists(lists, model, q, K * 2, TRAINED_NPROBE), base(spark, sf), q, K)


@query("ivf_codes_recall")
def ivf_codes_recall(spark, sf):
    """Recall of the stored lists of codes before and after refinement."""
    model, lists = stored_lists(spark, sf)
    b, q = base(spark, sf), probe_queries(spark, sf)
    found, truth = ann.search_lists(lists, model, q, K * 2, TRAINED_NPROBE), vectors.knn_exact(b, q, K)
    tag = lambda df, name: vectors.recall_at_k(df, truth, K).withColumn("stage", F.lit(name))
    return tag(found, "codes").unionByName(tag(ann.refine(found, b, q, K), "refined"))


@query("evaluation_report", f"""
WITH f AS (SELECT {NPROBE}::BIGINT AS setting, q, row_id, rank FROM ivf UNION ALL SELECT {LISTS}, q, row_id, k FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS k FROM ivs) WHERE k <= {K}),
  t AS (SELECT q, row_id, k FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS k FROM ivs) WHERE k <= {K}),
  runs AS (SELECT s AS setting, q, q // 50 % 2 AS grp, CAST(q * 7 % 13 + s AS DOUBLE) AS ms FROM ivq, (SELECT unnest([{NPROBE}, {LISTS}]::BIGINT[]) AS s))
SELECT setting, grp, count(*) AS n_queries,
  round(avg((SELECT count(*) FROM f JOIN t USING (q, row_id) WHERE f.setting = runs.setting AND f.q = runs.q) / {K}.0::DOUBLE), 9) AS recall_{K},
  round(avg((SELECT count(*) FROM f JOIN t USING (q, row_id) WHERE f.setting = runs.setting AND f.q = runs.q AND f.rank <= 10 AND t.k <= 10) / 10.0::DOUBLE), 9) AS recall_10,
  quantile_cont(ms, 0.5) AS p50_ms, round(quantile_cont(ms, 0.95), 9) AS p95_ms FROM runs GROUP BY setting, grp""")
def evaluation_report(spark, sf):
    """Recall and percentiles of two settings, for even and odd queries. The times stand in for measured ones, so that SQL can follow: a function
    of query and setting, no measurement. ``evaluation_report_trained`` measures."""
    model, index = ivf(spark, sf)
    q = probe_queries(spark, sf)
    found = None
    for lists in (NPROBE, LISTS):
        one = ann.ivf_search(index, model, q, K, lists).withColumn("setting", F.lit(lists).cast("long"))
        found = one if found is None else found.unionByName(one)
    timings = q.select("q", F.explode(F.array(F.lit(NPROBE), F.lit(LISTS))).alias("setting")).withColumn("setting", F.col("setting").cast("long"))
    timings = timings.withColumn("ms", (F.col("q") * 7 % 13 + F.col("setting")).cast("double"))
    groups = q.select("q", F.expr("q div 50 % 2").alias("grp"))
    out = vectors.evaluation_report(found, vectors.knn_exact(base(spark, sf), q, K), timings, groups, (K, 10))
    return out.withColumns({c: F.round(c, 9) for c in (f"recall_{K}", "recall_10", "p95_ms")})


#: Batches of a query group that are timed one by one.
TIMED_BATCHES = 3


@query("evaluation_report_trained")
def evaluation_report_trained(spark, sf):
    """Recall and measured time of two settings of the trained index, for even and odd queries.

    A query's time is that of its batch, searched and written as one job, divided by the batch's queries.
    """
    ensure_checkpoint_dir(spark)
    model, index = ivf_trained(spark, sf)
    index, q = index.checkpoint(), probe_queries(spark, sf).withColumn("grp", F.expr("q div 50 % 2")).checkpoint()
    batch = F.expr(f"q div 100 % {TIMED_BATCHES}")
    found = timings = None
    for lists in (TRAINED_NPROBE, TRAINED_LISTS):
        for grp, number in [(g, n) for g in range(2) for n in range(TIMED_BATCHES)]:
            some = q.filter((F.col("grp") == grp) & (batch == number))
            asked = some.count()
            if not asked:
                continue
            start = time.perf_counter()
            hits = ann.ivf_search(index, model, some.drop("grp"), K, lists).checkpoint()
            ms = (time.perf_counter() - start) * 1000 / asked
            hits = hits.withColumn("setting", F.lit(lists).cast("long"))
            times = some.select("q", F.lit(lists).cast("long").alias("setting"), F.lit(ms).alias("ms"))
            found, timings = (hits, times) if found is None else (found.unionByName(hits), timings.unionByName(times))
    truth = vectors.knn_exact(base(spark, sf), q.drop("grp"), K).checkpoint()  # the report reads it for each number of results
    return vectors.evaluation_report(found, truth, timings, q.select("q", "grp"), (K, 10))


@query("sq8_ranges", "SELECT dim, min(v) AS lo, max(v) AS hi FROM dims GROUP BY dim")
def sq8_ranges(spark, sf):
    return vectors.sq8_train(base(spark, sf))


part("rng", "SELECT dim, min(v) AS lo, max(v) - min(v) AS span FROM dims GROUP BY dim")
part("sq8", """
SELECT row_id, list(code ORDER BY dim) AS codes, list((code + 0.5::DOUBLE) / 255 * span + lo ORDER BY dim) AS e FROM (
  SELECT row_id, dim, lo, span, CAST(floor((v - lo) / span * 255) AS INTEGER) AS code FROM dims JOIN rng USING (dim)) GROUP BY row_id""")


@query("sq8_encode", "SELECT row_id, codes FROM sq8")
def sq8_encode(spark, sf):
    b = base(spark, sf)
    return vectors.sq8_encode(b, vectors.sq8_train(b)).select("row_id", "codes")


@query("sq8_search", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS rank FROM (
  SELECT q, row_id, round(list_inner_product(sq8.e, cent.e), 6) AS score FROM sq8, cent)) WHERE rank <= {K}""")
def sq8_search(spark, sf):
    b = base(spark, sf)
    ranges = vectors.sq8_train(b)
    return vectors.knn_exact(vectors.sq8_decode(vectors.sq8_encode(b, ranges), ranges), centroids(spark, sf), K)


SUBS, PQ_CODES = 8, 16

part("pqc", f"""
SELECT code, s, e[s * 8 + 1:s * 8 + 8] AS c FROM (SELECT row_number() OVER (ORDER BY md5('2:' || row_id), row_id) - 1 AS code, e FROM emb),
  (SELECT unnest(range({SUBS})) AS s) WHERE code < {PQ_CODES}""")
part("pqe", """
SELECT row_id, s, code, c FROM (
  SELECT row_id, s, code, c, row_number() OVER (PARTITION BY row_id, s ORDER BY list_inner_product(c, c) - 2 * list_inner_product(e[s * 8 + 1:s * 8 + 8], c), code) AS k
  FROM emb, pqc) WHERE k = 1""")
part("pqs", f"""
SELECT q, row_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS rank FROM (
  SELECT q, row_id, round(sum(list_inner_product(ivq.e[s * 8 + 1:s * 8 + 8], c)), 6) AS score FROM pqe, ivq GROUP BY q, row_id)) WHERE rank <= {4 * K}""")
part("pqr", f"""
SELECT q, row_id FROM (SELECT q, row_id, row_number() OVER (PARTITION BY q ORDER BY ivs.score DESC, row_id) AS k FROM pqs JOIN ivs USING (q, row_id)) WHERE k <= {K}""")


def pq_books(spark, sf):
    """Codebooks from seeded rows; training is tested apart."""
    return ann.seeded_rows(base(spark, sf), PQ_CODES, 2).reshape(PQ_CODES, SUBS, -1).transpose(1, 0, 2).copy()


@query("pq_encode", "SELECT row_id, CAST(s AS INTEGER) AS sub, CAST(code AS INTEGER) AS code FROM pqe")
def pq_encode(spark, sf):
    codes = ann.pq_encode(base(spark, sf), pq_books(spark, sf))
    byte = F.transform(F.sequence(F.lit(1), F.lit(SUBS)), lambda i: F.conv(F.hex(F.substring("codes", i, F.lit(1))), 16, 10).cast("int"))
    return codes.select("row_id", F.posexplode(byte).alias("sub", "code"))


@query("pq_search", "SELECT * FROM pqs")
def pq_search(spark, sf):
    books = pq_books(spark, sf)
    return ann.pq_search(ann.pq_encode(base(spark, sf), books), books, probe_queries(spark, sf), K * 4)


@query("pq_search_refined", "SELECT stage, count(*) AS n_queries, round(avg(r), 9) AS recall FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS stage, (SELECT count(*) FROM ivt t JOIN {found} f USING (q, row_id) WHERE t.q = ivq.q) / {K}.0::DOUBLE AS r FROM ivq"
    for name, found in (("codes", f"(SELECT q, row_id FROM pqs WHERE rank <= {K})"), ("refined", "pqr"))) + ") GROUP BY stage")
def pq_search_refined(spark, sf):
    """Recall of product-quantised search before and after refinement."""
    b, q, books = base(spark, sf), probe_queries(spark, sf), pq_books(spark, sf)
    candidates = ann.pq_search(ann.pq_encode(b, books), books, q, K * 4)
    truth = vectors.knn_exact(b, q, K)
    tag = lambda df, name: vectors.recall_at_k(df, truth, K).withColumn("stage", F.lit(name)).withColumn("recall", F.round("recall", 9))
    return tag(candidates, "codes").unionByName(tag(ann.refine(candidates, b, q, K), "refined"))


#: Trained codebooks, and candidates per result that are rescored.
TRAINED_SUBS, TRAINED_CODES, TRAINED_FETCH = 16, 256, 8


def pq_trained(spark, sf):
    """Codebooks by k-means over the whole table, and its codes."""
    b = base(spark, sf)
    books = ann.pq_train(b, TRAINED_SUBS, TRAINED_CODES, seed=2)
    return books, ann.pq_encode(b, books)


@query("pq_encode_trained")
def pq_encode_trained(spark, sf):
    return pq_trained(spark, sf)[1]


@query("pq_search_trained")
def pq_search_trained(spark, sf):
    """Nearest rows by trained codes, rescored exactly."""
    books, coded = pq_trained(spark, sf)
    q = probe_queries(spark, sf)
    return ann.refine(ann.pq_search(coded, books, q, K * TRAINED_FETCH), base(spark, sf), q, K)


@query("pq_search_refined_trained")
def pq_search_refined_trained(spark, sf):
    """Recall of trained codes before and after refinement."""
    b, q = base(spark, sf), probe_queries(spark, sf)
    books, coded = pq_trained(spark, sf)
    candidates = ann.pq_search(coded, books, q, K * TRAINED_FETCH)
    truth = vectors.knn_exact(b, q, K)
    tag = lambda df, name: vectors.recall_at_k(df, truth, K).withColumn("stage", F.lit(name))
    return tag(candidates, "codes").unionByName(tag(ann.refine(candidates, b, q, K), "refined"))


@query("refine", "SELECT * FROM knnt")
def refine(spark, sf):
    """Refining a superset of the answer gives the exact answer."""
    b, q = base(spark, sf), centroids(spark, sf)
    return ann.refine(vectors.knn_exact(b, q, K * 4), b, q, K)


part("i8", """
SELECT row_id, label, scale, list_transform(e, lambda x: CAST(round_even(x / scale, 0) AS INTEGER)) AS codes FROM (
  SELECT *, list_max(list_transform(e, lambda x: abs(x))) / 127 AS scale FROM emb)""")


@query("int8_encode", "SELECT row_id, round(scale, 12) AS scale, codes FROM i8")
def int8_encode(spark, sf):
    return vectors.int8_encode(base(spark, sf)).select("row_id", F.round("scale", 12).alias("scale"), "codes")


part("i8d", """
SELECT row_id, list_transform(codes, lambda c: c / sqrt(list_inner_product(codes, codes))) AS e FROM (
  SELECT row_id, CAST(codes AS DOUBLE[]) AS codes FROM i8)""")
part("i8k", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, row_id) AS rank FROM (
  SELECT q, row_id, round(list_inner_product(i8d.e, cent.e), 6) AS score FROM i8d, cent)) WHERE rank <= {K}""")


@query("int8_search", "SELECT * FROM i8k")
def int8_search(spark, sf):
    return vectors.knn_exact(vectors.int8_decode(vectors.int8_encode(base(spark, sf))), centroids(spark, sf), K)


@query("recall_at_k", f"""
SELECT grp, count(*) AS n_queries, round(avg(r), 9) AS recall FROM (
  SELECT q, q % 2 AS grp, (SELECT count(*) FROM knnt t JOIN i8k f USING (q, row_id) WHERE t.q = c.q) / {K}.0::DOUBLE AS r FROM cent c) GROUP BY grp""")
def recall_at_k(spark, sf):
    b, q = base(spark, sf), centroids(spark, sf)
    found = vectors.knn_exact(vectors.int8_decode(vectors.int8_encode(b)), q, K)
    groups = q.select("q", (F.col("q") % 2).alias("grp"))
    return vectors.recall_at_k(found, vectors.knn_exact(b, q, K), K, groups).withColumn("recall", F.round("recall", 9))


def _points(spark, sf):
    return base(spark, sf).select("row_id", (F.col("label") * 65536 + F.col("row_id")).alias("ref"), F.col("label").cast("string").alias("subset"))


def _placed(spark, sf):
    b = base(spark, sf)
    return b.select("row_id", (F.col("row_id") % 64).alias("chunk_id"), (F.col("label")).alias("local_id"))


@query("resolve_hits", """
SELECT q, row_id, score, rank, row_id % 64 AS chunk_id, label AS local_id, label * 65536 + row_id AS ref, CAST(label AS VARCHAR) AS subset
FROM knnt JOIN emb USING (row_id)""")
def resolve_hits(spark, sf):
    hits = vectors.knn_exact(base(spark, sf), centroids(spark, sf), K)
    return vectors.resolve_hits(hits, _placed(spark, sf), _points(spark, sf))


@query("map_ann_hits", """
SELECT q, row_id, score FROM knnt JOIN emb USING (row_id) WHERE label <> 4""")
def map_ann_hits(spark, sf):
    """ANN ids run backwards; one label has no row."""
    b = base(spark, sf)
    last = b.agg(F.max("row_id")).first()[0]
    ann_id = (F.lit(last) - F.col("row_id")).alias("ann_id")
    hits = vectors.knn_exact(b, centroids(spark, sf), K).select("q", ann_id, "score")
    row = F.when(F.col("label") == 4, F.lit(keys.MISSING)).otherwise(F.col("row_id")).cast("long")
    return vectors.map_ann_hits(hits, b.select(ann_id, row.alias("row_id")))


@query("filter_hits", "SELECT q, row_id, score, rank FROM knnt JOIN emb USING (row_id) WHERE label < 5")
def filter_hits(spark, sf):
    b = base(spark, sf)
    return vectors.filter_hits(vectors.knn_exact(b, centroids(spark, sf), K), b.filter(F.col("label") < 5))


@query("validate_hits", f"""
SELECT q, row_id, 'out of range' AS problem FROM knnt WHERE row_id >= 300
UNION ALL SELECT q, -1, 'too many results' FROM knnt GROUP BY q HAVING count(*) > 20
UNION ALL SELECT q, row_id, 'url does not match ref' FROM knnt JOIN emb USING (row_id) WHERE label = 2""")
def validate_hits(spark, sf):
    hits = vectors.resolve_hits(vectors.knn_exact(base(spark, sf), centroids(spark, sf), K), _placed(spark, sf), _points(spark, sf))
    shown = F.when(F.col("subset") == "2", F.col("ref") + 1).otherwise(F.col("ref"))
    return vectors.validate_hits(hits.withColumn("url", F.concat(F.lit("https://host/item/"), shown.cast("string"))), 300, 20)


def _projection(d=64, out=8):
    """A fixed linear map: mean 0.01, components (i * j mod 7) - 3 over 10."""
    i, j = np.meshgrid(np.arange(1, d + 1), np.arange(1, out + 1), indexing="ij")
    return np.full(d, 0.01), ((i * j) % 7 - 3) / 10.0


part("proj", """
SELECT row_id, j, sum((v - 0.01::DOUBLE) * (((dim + 1) * j) % 7 - 3) / 10.0::DOUBLE) AS y
FROM dims, (SELECT unnest(range(1, 9)) AS j) GROUP BY 1, 2""")


@query("project_affine", """
SELECT row_id, CAST(j AS INTEGER) - 1 AS axis, round(y / sqrt(sum(y * y) OVER (PARTITION BY row_id)), 6) AS value FROM proj""")
def project_affine(spark, sf):
    out = vectors.project_affine(base(spark, sf), *_projection())
    return out.select("row_id", F.posexplode("projected").alias("axis", "value")).withColumn("value", F.round("value", 6))


@query("project_head", """
SELECT row_id, round(0.5::DOUBLE + sum(greatest(y, 0)) FILTER (j <= 4), 6) AS x, round(sum(greatest(y, 0)) FILTER (j > 4) - 0.5::DOUBLE, 6) AS y FROM proj GROUP BY 1""")
def project_head(spark, sf):
    mean, comp = _projection()
    second = np.zeros((8, 2))
    second[:4, 0] = second[4:, 1] = 1.0
    out = vectors.project_head(base(spark, sf), [(comp, -mean @ comp), (second, [0.5, -0.5])], ["x", "y"])
    return out.select("row_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("projection_error", "SELECT count(*) AS n_rows, 0::BIGINT AS n_missing, 0.0005::DOUBLE AS max_error, true AS ok FROM range(101)")
def projection_error(spark, sf):
    """Stored coordinates are shifted by 0.0005 and checked on 101 evenly spaced rows."""
    b = base(spark, sf)
    mean, comp = _projection()
    layer = [(comp[:, :2], -mean @ comp[:, :2])]
    stored = vectors.project_head(b, layer, ["x", "y"]).withColumn("x", F.col("x") + 0.0005)
    again = vectors.project_head(linspace_sample(b, b.count(), 101), layer, ["x", "y"])
    return vectors.projection_error(again, stored, ["x", "y"]).withColumn("max_error", F.round("max_error", 6))


@query("latency_summary", """
SELECT event_type AS config, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  arg_min(value, event_id) AS first_ms, max(value) AS max_ms FROM events GROUP BY 1""")
def latency_summary(spark, sf):
    from embedmap.operators.metrics import latency_summary as run

    ev = table(spark, sf, "events").select(F.col("event_type").alias("config"), F.col("event_id").alias("seq"), F.col("value").alias("ms"))
    out = run(ev, "config")
    return out.withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


@query("search_report", """
SELECT n_name AS build, CAST(n_nationkey * 1000 AS BIGINT) AS bytes, s AS setting, CASE WHEN n_nationkey % 5 = 0 THEN 'failed' ELSE '' END AS error,
  coalesce(c, 0) AS n_eval
FROM nation, (SELECT unnest(['BUILDING', 'MACHINERY', 'OTHER']) AS s)
LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS c FROM customer GROUP BY 1, 2) ON c_nationkey = n_nationkey AND c_mktsegment = s""")
def search_report(spark, sf):
    builds = table(spark, sf, "nation").select(
        F.col("n_name").alias("build"), (F.col("n_nationkey") * 1000).cast("long").alias("bytes"),
        F.lit(["BUILDING", "MACHINERY", "OTHER"]).alias("settings"), F.when(F.col("n_nationkey") % 5 == 0, "failed").otherwise("").alias("error"))
    evals = table(spark, sf, "customer").groupBy(
        F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("build"), F.col("c_mktsegment").alias("setting")
    ).agg(F.count(F.lit(1)).alias("n_eval"))
    return vectors.search_report(builds, evals).na.fill(0, ["n_eval"])
