"""Approximate search: coarse lists, product quantisation, refinement.

The index is a DataFrame: base rows with a list id (and codes). Probing prunes lists; scoring runs where the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmap.operators import blocks
from embedmap.operators.ordering import limit_per_group, md5_priority
from embedmap.operators.vectors import matrix, number_type, query_blocks, scores
from embedmap.session import cut

CODES = 256  # largest codebook: a code is one byte
LIST_VALUES = 1 << 17  # values in a block of one list
LIST_GROUP_BYTES = 1 << 20  # row group of a stored list index


def seeded_rows(base: DataFrame, k: int, seed: int) -> np.ndarray:
    """Vectors of the k first rows by a seeded hash."""
    rows = base.select(F.col("row_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"), md5_priority(seed, "row_id").alias("_p"))
    found = [r.e for r in rows.orderBy("_p", "row_id").limit(k).collect()]
    if len(found) < k:
        raise ValueError(f"{k} rows wanted, {len(found)} there")
    return np.array(found)


@dataclass
class Ivf:
    """Coarse centroids (list id = position) and the metric."""

    centroids: np.ndarray
    metric: str = "ip"


def ivf_train(base: DataFrame, lists: int, seed: int = 0, metric: str = "ip", iterations: int = 20) -> Ivf:
    """k-means over all rows of ``base``. To train on fewer, pass fewer."""
    rows = base.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=iterations, featuresCol="features").fit(rows)
    centres = np.array(model.clusterCenters())
    if len(centres) < lists:
        raise ValueError(f"{lists} lists wanted, the rows give {len(centres)}")
    return Ivf(centres, metric)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(axis=1)[None, :] - 2.0 * (x @ centroids.T), axis=1)


def ivf_assign(base: DataFrame, ivf: Ivf) -> DataFrame:
    """Base rows with their list id. Narrow: the centroids are broadcast."""
    shared = base.sparkSession.sparkContext.broadcast(ivf.centroids)

    def run(batches):
        for b in batches:
            ids = nearest_centroid(matrix(b.column(1)), shared.value).astype(np.int64) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids)], names=["row_id", "embedding", "list_id"])

    src = base.select(F.col("row_id").cast("long"), F.col("embedding").cast("array<float>"))
    return src.mapInArrow(run, "row_id long, embedding array<float>, list_id long")


def write_ivf(index: DataFrame, path: str) -> None:
    """Sorted by list within range partitions: probes prune row groups, and a crowded list spans several files."""
    index.repartitionByRange("list_id", "row_id").sortWithinPartitions("list_id", "row_id").write.mode("errorifexists").parquet(path)


def read_ivf(spark: SparkSession, path: str) -> DataFrame:
    """A stored index; a search's filter on its lists reaches the scan, which skips row groups by it."""
    return spark.read.parquet(path)


def probes(ivf: Ivf, q: np.ndarray, nprobe: int) -> np.ndarray:
    """The nearest lists of every query."""
    c = ivf.centroids
    d = (c * c).sum(axis=1)[None, :] - 2.0 * (q @ c.T)
    return np.argsort(d, axis=1, kind="stable")[:, : min(nprobe, len(c))]


def probed(ivf: Ivf, queries: DataFrame, nprobe: int) -> DataFrame:
    """Query blocks by probed list: every query goes to its ``nprobe`` nearest lists."""
    shared = queries.sparkSession.sparkContext.broadcast(ivf)

    def run(batches):
        for b in batches:
            if b.num_rows:
                lists = probes(shared.value, matrix(b.column(1)), nprobe)
                each = np.repeat(np.arange(b.num_rows), lists.shape[1])
                yield pa.record_batch([b.column(0).take(pa.array(each)), b.column(1).take(pa.array(each)), pa.array(lists.ravel().astype(np.int64))], names=["q", "embedding", "list_id"])

    source = queries.select(F.col("q").cast("long"), F.col("embedding").cast("array<double>"))
    return blocks.pack(source.mapInArrow(run, "q long, embedding array<double>, list_id long"), matrix, blocks.QUERY_VALUES, "list_id")


def ivf_search(index: DataFrame, ivf: Ivf, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Top-k inside the nprobe nearest lists of each query, over assigned rows. Probing every list equals the exact search.

    Only the lists that some query probes are packed, and a list meets just the queries that probe it.
    """
    asked = cut(probed(ivf, queries, nprobe))
    wanted = index.select("row_id", "embedding", "list_id").filter(F.col("list_id").isin(blocks.wanted_keys(asked)))
    kind = number_type(index)
    data = blocks.pack(wanted, lambda c: matrix(c).astype(kind), LIST_VALUES, "list_id")
    return blocks.nearest(data, asked, k, lambda key, q, x: scores(ivf.metric, x.astype(np.float64), q), kind)


# --- stored lists of residual codes -----------------------------------------------------------------------------------

@dataclass
class ListCodes:
    """Coarse lists, and per dimension the range of what is left of a vector after its centroid is taken away."""

    ivf: Ivf
    low: np.ndarray
    span: np.ndarray

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        unit = (x - self.ivf.centroids[lists] - self.low) / np.where(self.span == 0, 1.0, self.span)
        return np.floor(np.clip(unit, 0.0, 1.0) * 255.0).astype(np.uint8)

    def scores(self, lists: int, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products with the decoded rows of one list: a table per query and list, then one product with the codes."""
        step = self.span / 255.0
        whole = q @ (self.ivf.centroids[lists] + self.low + 0.5 * step)
        return (q * step).astype(np.float32) @ codes.T.astype(np.float32) + whole[:, None]


def train_codes(base: DataFrame, ivf: Ivf) -> ListCodes:
    """Ranges of the residuals of all rows; a task hands on one row per dimension."""
    if ivf.metric != "ip":
        raise ValueError("codes score inner products")
    shared = base.sparkSession.sparkContext.broadcast(ivf.centroids)

    def run(batches):
        low = high = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                r = x - shared.value[nearest_centroid(x, shared.value)]
                low, high = (r.min(axis=0), r.max(axis=0)) if low is None else (np.minimum(low, r.min(axis=0)), np.maximum(high, r.max(axis=0)))
        if low is not None:
            yield pa.record_batch([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], names=["dim", "low", "high"])

    rows = base.select("embedding").mapInArrow(run, "dim long, low double, high double").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    low, high = (np.array([r[c] for r in rows]) for c in ("low", "high"))
    return ListCodes(ivf, low, high - low)


def code_blocks(base: DataFrame, model: ListCodes) -> DataFrame:
    """Blocks of codes by list: key (the list), block, ids, data. Rows are encoded before they are sorted by list."""
    shared = base.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                lists = nearest_centroid(x, shared.value.ivf.centroids)
                codes = shared.value.encode(x, lists)
                yield pa.record_batch([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lists.astype(np.int64))], names=["row_id", "codes", "list_id"])

    coded = base.select(F.col("row_id").cast("long"), "embedding").mapInArrow(run, "row_id long, codes binary, list_id long")
    ordered = coded.repartitionByRange("list_id", "row_id").sortWithinPartitions("list_id", "row_id")
    return blocks.pack(ordered, code_matrix, LIST_VALUES, "list_id")


def write_lists(lists: DataFrame, path: str) -> None:
    """Store blocks sorted by list within range partitions, in small row groups: a search skips the groups of other lists, and a crowded
    list spans several files."""
    blocks.write(lists, path, LIST_GROUP_BYTES)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search_lists(stored: DataFrame, model: ListCodes, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Top-k by codes inside the nprobe nearest lists of every query: q, row_id, score, rank. The filter on the probed lists reaches the scan."""
    asked = cut(probed(model.ivf, queries, nprobe))
    data = stored.filter(F.col("key").isin(blocks.wanted_keys(asked)))
    shared = queries.sparkSession.sparkContext.broadcast(model)
    return blocks.nearest(data, asked, k, lambda key, q, codes: shared.value.scores(key, q, codes), "u1")


def search_lists_exact(stored: DataFrame, model: ListCodes, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The exact top-k by the codes of all lists: q, row_id, score, rank.

    A row's score is off its codes' by at most ``slack``, so no row of the answer scores less by codes than the k-th best by codes minus twice
    that: all rows above this bar are rescored, however many they are. ``base``: the rows that ``model`` was trained on.
    """
    found = search_lists(stored, model, queries, k, len(model.ivf.centroids))
    bars = found.groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("_kth"))
    spans = F.array(*[F.lit(float(v)) for v in model.span])
    reach = F.aggregate(F.zip_with("embedding", spans, lambda a, b: F.abs(a) * b), F.lit(0.0), lambda a, b: a + b)
    # Half a step of every dimension, the rounding of codes' sums in single precision, and that of scores.
    slack = reach * (0.5 / 255 + len(model.span) * 2.0**-22) + 2 * blocks.MARGIN
    vectors = queries.select(F.col("q").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    bar = F.coalesce(F.col("_kth") - 2 * slack, F.lit(float("-inf")))
    marked = vectors.join(bars, "q", "left").select("q", F.concat("embedding", F.array(bar)).alias("embedding"),
                                                    F.explode(F.sequence(F.lit(0), F.lit(len(model.ivf.centroids) - 1))).alias("list_id"))
    asked = cut(blocks.pack(marked, matrix, blocks.QUERY_VALUES, "list_id"))
    shared = queries.sparkSession.sparkContext.broadcast(model)
    return refine(blocks.above(stored, asked, lambda key, q, codes: shared.value.scores(key, q, codes), "u1"), base, queries, k)


# --- product quantisation ---------------------------------------------------------------------------------------------

def _code_sums(books: np.ndarray):
    """Per task: number and sum of the sub-vectors nearest to each code, as rows (sub, code, dim, total, n)."""
    m, k, w = books.shape

    def run(batches):
        sums, sizes = np.zeros((m, k, w)), np.zeros((m, k), np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0)).reshape(b.num_rows, m, w)
                for s in range(m):
                    near = nearest_centroid(x[:, s], books[s])
                    for dim in range(w):
                        sums[s, :, dim] += np.bincount(near, x[:, s, dim], k)
                    sizes[s] += np.bincount(near, minlength=k)
        sub, code, dim = (a.ravel() for a in np.indices((m, k, w)))
        kept = np.repeat(sizes.ravel() > 0, w)
        yield pa.RecordBatch.from_arrays([pa.array(a[kept]) for a in (sub, code, dim, sums.ravel(), np.repeat(sizes.ravel(), w))],
                                         names=["sub", "code", "dim", "total", "n"])

    return run


def pq_train(base: DataFrame, m: int, codes: int, seed: int = 0, iterations: int = 15) -> np.ndarray:
    """Codebooks (m, codes, d/m) by k-means over all rows: tasks add up their rows, the driver sees codebooks only."""
    if not 0 < codes <= CODES:
        raise ValueError(f"a codebook has 1..{CODES} codes")
    start = seeded_rows(base, codes, seed)
    books = start.reshape(codes, m, -1).transpose(1, 0, 2).copy()
    for _ in range(iterations):
        sums = base.select("embedding").mapInArrow(_code_sums(books), "sub long, code long, dim long, total double, n long")
        means = sums.groupBy("sub", "code", "dim").agg((F.sum("total") / F.sum("n")).alias("v")).toPandas()
        moved = books.copy()
        moved[means["sub"], means["code"], means["dim"]] = means["v"]
        if np.abs(moved - books).max() < 1e-9:
            break
        books = moved
    return books


def pq_encode(base: DataFrame, books: np.ndarray) -> DataFrame:
    """One byte per sub-space: row_id, codes."""
    shared = base.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        bk = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1)).reshape(b.num_rows, len(bk), -1)
            codes = np.stack([nearest_centroid(x[:, s], bk[s]) for s in range(len(bk))], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in codes], type=pa.binary())], names=["row_id", "codes"])

    return base.select(F.col("row_id").cast("long"), "embedding").mapInArrow(run, "row_id long, codes binary")


def code_matrix(column: pa.Array) -> np.ndarray:
    """Codes of an Arrow binary column, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def pq_search(encoded: DataFrame, books: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """Top-k by inner product of the query with the decoded codes, through lookup tables of all queries of a block."""
    shared = encoded.sparkSession.sparkContext.broadcast(books)

    def score(key, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        bk = shared.value
        tables = np.einsum("qsd,scd->sqc", q.reshape(len(q), len(bk), -1), bk)
        total = tables[0][:, codes[:, 0]]
        for s in range(1, len(bk)):
            total += tables[s][:, codes[:, s]]
        return total

    data = blocks.pack(encoded.select("row_id", "codes"), code_matrix, blocks.DATA_VALUES)
    return blocks.nearest(data, cut(query_blocks(queries)), k, score, "u1")


def refine(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rescore over-fetched candidates exactly (inner product) and keep the best k. candidates: q, row_id."""
    from embedmap.functions.vectors import dot

    pairs = candidates.select("q", "row_id").join(base.select("row_id", F.col("embedding").alias("_x")), "row_id").join(
        queries.select("q", F.col("embedding").alias("_q")), "q"
    )
    scored = pairs.select("q", "row_id", F.round(dot(F.col("_x"), F.col("_q")), 6).alias("score"))
    return limit_per_group(scored, ["q"], [F.desc("score"), "row_id"], k)
