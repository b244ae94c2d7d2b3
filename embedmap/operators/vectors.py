"""Batch vector search: exact top-k, scalar quantisation, frozen projections, recall.

Queries and base vectors meet as blocks (see ``blocks``); each task keeps only its k best rows per query, so no pair is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedmap.functions import vectors as vf
from embedmap.operators import blocks
from embedmap.operators.keys import MISSING, duplicate_keys, refusing_join
from embedmap.operators.metadata import MapIdentity, bound
from embedmap.operators.ordering import exact_percentiles
from embedmap.session import cut



def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("null vector or component")
    sizes = pc.list_value_length(column)
    if pc.min(sizes) != pc.max(sizes):
        raise ValueError("vectors of different lengths")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def vectors_of(m: np.ndarray, valid: np.ndarray | None = None) -> pa.ListArray:
    """A matrix as an Arrow list column; rows that are not valid become null."""
    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(offsets, pa.array(m.ravel()), mask=mask)


def map_vectors(df: DataFrame, uses: Sequence[str], fn: Callable, added: Sequence[tuple[str, str]]) -> DataFrame:
    """Replace the columns ``uses`` by ``added``, computed batch by batch; all other columns pass through."""
    keep = [c for c in df.columns if c not in uses]
    types = {n: t for n, t in df.dtypes}
    schema = ", ".join(f"`{n}` {t}" for n, t in [*((c, types[c]) for c in keep), *added])
    names = [*keep, *[n for n, _ in added]]

    def run(batches):
        for b in batches:
            if b.num_rows:
                made = fn(*[b.column(len(keep) + i) for i in range(len(uses))])
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *made], names=names)

    return df.select(*keep, *uses).mapInArrow(run, schema)


def l2_normalize(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Unit vectors in double; a vector that cannot be normalised stops the job that reads this."""

    def unit(column):
        m = matrix(column)
        length = np.linalg.norm(m, axis=1)
        if not (np.isfinite(length) & (length > 0)).all():
            raise ValueError("zero or non-finite vector")
        return [vectors_of(m / length[:, None])]

    return map_vectors(df, [col], unit, [(col, "array<double>")])


def invalid_vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.filter(vf.bad_vector(F.col(col)))


def scores(metric: str, base: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Score matrix (queries x rows), larger is better: inner product, cosine, or negative squared distance."""
    if metric == "ip":
        return q @ base.T
    if metric == "cosine":
        return (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (base / np.linalg.norm(base, axis=1, keepdims=True)).T
    if metric == "l2":
        return 2.0 * (q @ base.T) - (q * q).sum(axis=1)[:, None] - (base * base).sum(axis=1)[None, :]
    raise ValueError(f"unknown metric {metric}")


def number_type(df: DataFrame, col: str = "embedding") -> str:
    """Numbers to store for a vector column: single precision for array<float>, double for the rest."""
    return "<f4" if isinstance(df.schema[col].dataType.elementType, T.FloatType) else "<f8"


def vector_blocks(base: DataFrame) -> DataFrame:
    """row_id, embedding as blocks that a search reads; may be stored and read again."""
    kind = number_type(base)
    return blocks.pack(base.select("row_id", "embedding"), lambda c: matrix(c).astype(kind), blocks.DATA_VALUES)


def query_blocks(queries: DataFrame) -> DataFrame:
    """q, embedding as blocks of doubles, packed in tasks."""
    return blocks.pack(queries.select("q", vf.as_double(F.col("embedding"))), matrix, blocks.QUERY_VALUES)


def knn_blocks(data: DataFrame, queries: DataFrame, k: int, metric: str = "ip", kind: str = "<f4") -> DataFrame:
    """Exact top-k of every query over ``vector_blocks``; ``kind`` is their number type."""
    scores(metric, np.zeros((1, 1)) + 1, np.ones((1, 1)))
    return blocks.nearest(data, cut(query_blocks(queries)), k, lambda key, q, x: scores(metric, x.astype(np.float64), q), kind)


def knn_exact(base: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """Exact top-k of every query: q, row_id, score, rank. base: row_id, embedding; queries: q, embedding."""
    return knn_blocks(vector_blocks(base), queries, k, metric, number_type(base))


def recall_at_k(found: DataFrame, truth: DataFrame, k: int, groups: DataFrame | None = None) -> DataFrame:
    """Share of the true first k found among the first k, averaged over queries; per query group when given (q, grp)."""
    top = lambda df: df.filter(F.col("rank") <= k).select("q", "row_id")
    hit = top(truth).join(top(found).withColumn("_hit", F.lit(1)), ["q", "row_id"], "left")
    per_query = hit.groupBy("q").agg((F.count("_hit") / F.lit(float(k))).alias("recall"))
    if groups is None:
        return per_query.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall"))
    return per_query.join(groups, "q").groupBy("grp").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall"))


# --- per-row int8 -----------------------------------------------------------------------------------------------------

def int8_encode(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Symmetric 8-bit codes with one scale per row."""

    def encode(column):
        m = matrix(column)
        peak = np.abs(m).max(axis=1)
        scale = np.where(peak == 0, 1.0, peak / 127.0)
        return [pa.array(scale), vectors_of(np.clip(np.rint(m / scale[:, None]), -127, 127).astype(np.int32))]

    return map_vectors(df, [col], encode, [("scale", "double"), ("codes", "array<int>")])


def int8_decode(df: DataFrame, renormalize: bool = True) -> DataFrame:
    """Vectors from codes, renormalised; a zero vector cannot be and becomes null."""

    def decode(scale, codes):
        m = matrix(codes) * scale.to_numpy()[:, None]
        if not renormalize:
            return [vectors_of(m)]
        length = np.linalg.norm(m, axis=1)
        return [vectors_of(m / np.where(length == 0, 1.0, length)[:, None], length > 0)]

    return map_vectors(df, ["scale", "codes"], decode, [("embedding", "array<double>")])


# --- per-dimension 8-bit ----------------------------------------------------------------------------------------------

def sq8_train(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Minimum and maximum of every dimension: dim, lo, hi. Each task reduces its rows to one row per dimension."""

    def run(batches):
        lo = hi = None
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(0))
                lo = m.min(axis=0) if lo is None else np.minimum(lo, m.min(axis=0))
                hi = m.max(axis=0) if hi is None else np.maximum(hi, m.max(axis=0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lo))), pa.array(lo), pa.array(hi)], names=["dim", "lo", "hi"])

    partial = df.select(col).mapInArrow(run, "dim long, lo double, hi double")
    return partial.groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _ranges(ranges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The trained ranges (one entry per dimension): lower ends and spans, 1 where flat."""
    rows = ranges.orderBy("dim").collect()
    span = np.array([r["hi"] - r["lo"] for r in rows])
    return np.array([r["lo"] for r in rows]), np.where(span == 0, 1.0, span)


def sq8_encode(df: DataFrame, ranges: DataFrame, col: str = "embedding") -> DataFrame:
    lo, span = _ranges(ranges)

    def encode(column):
        unit = np.clip((matrix(column) - lo) / span, 0.0, 1.0)
        return [vectors_of(np.floor(unit * 255.0).astype(np.int32))]

    return map_vectors(df, [col], encode, [("codes", "array<int>")])


def sq8_decode(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Middle of the code's step."""
    lo, span = _ranges(ranges)
    return map_vectors(df, ["codes"], lambda c: [vectors_of((matrix(c) + 0.5) / 255.0 * span + lo)], [("embedding", "array<double>")])


# --- frozen projections -----------------------------------------------------------------------------------------------

def project_affine(df: DataFrame, mean: Sequence[float], components: Sequence[Sequence[float]], col: str = "embedding") -> DataFrame:
    """normalize((x - mean) @ components): one GEMM per Arrow batch with the matrices broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(mean, float), np.asarray(components, float)))

    def run(batches):
        mu, comp = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            y = (matrix(b.column(1)) - mu) @ comp
            length = np.linalg.norm(y, axis=1, keepdims=True)
            if not (np.isfinite(length) & (length > 0)).all():
                raise ValueError("projection cannot be normalised")
            y /= length
            yield pa.RecordBatch.from_arrays([b.column(0), vectors_of(y)], names=["row_id", "projected"])

    return df.select(F.col("row_id").cast("long"), col).mapInArrow(run, "row_id long, projected array<double>")


def project_head(df: DataFrame, layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]], out: Sequence[str], col: str = "embedding") -> DataFrame:
    """Coordinates from frozen dense layers (weights, bias), ReLU between them. Non-finite output is refused.

    The layers are given as data; nothing is trained here.
    """
    weights = [(np.asarray(w, float), np.asarray(b, float)) for w, b in layers]
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y = matrix(b.column(1))
            for i, (w, bias) in enumerate(shared.value):
                y = y @ w + bias
                if i + 1 < len(shared.value):
                    y = np.maximum(y, 0.0)
            if not np.isfinite(y).all():
                raise ValueError("projection produced a non-finite coordinate")
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(y[:, j].copy()) for j in range(y.shape[1])]], names=["row_id", *out])

    return df.select(F.col("row_id").cast("long"), col).mapInArrow(run, "row_id long, " + ", ".join(f"{c} double" for c in out))


def projection_error(recomputed: DataFrame, stored: DataFrame, cols: Sequence[str], tolerance: float = 1e-3) -> DataFrame:
    """Largest absolute difference of recomputed and stored coordinates, and whether it is within tolerance."""
    b = stored.select("row_id", *[F.col(c).alias(f"_{c}") for c in cols])
    worst = F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in cols]))
    out = recomputed.join(b, "row_id", "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f"_{cols[0]}").isNull()).alias("n_missing"), worst.alias("max_error")
    )
    return out.withColumn("ok", (F.col("n_missing") == 0) & (F.col("max_error") <= tolerance))


# --- search results ---------------------------------------------------------------------------------------------------

def resolve_hits(hits: DataFrame, row_to_voxel: DataFrame, points: DataFrame, identity: MapIdentity | None = None) -> DataFrame:
    """Place search results: q, rank, row_id, score, chunk_id, local_id, ref, subset. With an ``identity``, the results must be bound to it."""
    if identity is not None:
        hits = bound(hits, identity)
    placed = refusing_join(hits, row_to_voxel.select("row_id", "chunk_id", "local_id"), ["row_id"], "hit without a voxel")
    return refusing_join(placed, points.select("row_id", "ref", "subset"), ["row_id"], "hit without a point")


def hit_violations(hits: DataFrame, n: int) -> DataFrame:
    """Hits outside 0..n-1 and rows returned twice for one query."""
    outside = hits.filter(~F.col("row_id").between(0, n - 1)).select("q", "row_id", F.lit("out of range").alias("problem"))
    twice = duplicate_keys(hits, ["q", "row_id"]).select("q", "row_id", F.lit("duplicate").alias("problem"))
    return outside.unionByName(twice)


def map_ann_hits(hits: DataFrame, mapping: DataFrame) -> DataFrame:
    """ANN ids to rows; ids without a row are dropped. hits: q, ann_id, score."""
    return hits.join(mapping.select("ann_id", "row_id"), "ann_id").filter(F.col("row_id") != MISSING).select("q", "row_id", "score")


def filter_hits(hits: DataFrame, matches: DataFrame) -> DataFrame:
    """Retrieved candidates that match a metadata filter; the index itself is not searched again."""
    return hits.join(matches.select("row_id"), "row_id", "left_semi")


def validate_hits(hits: DataFrame, n: int, k: int = 24) -> DataFrame:
    """Problems of placed results: bounds, list length, repeated rows, and a url whose trailing number is not the ref."""
    per_query = hits.groupBy("q").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > k)
    long = per_query.select("q", F.lit(-1).cast("long").alias("row_id"), F.lit("too many results").alias("problem"))
    url_ref = F.regexp_extract("url", r"(\d+)$", 1)
    wrong = hits.filter(url_ref != F.col("ref").cast("string")).select("q", "row_id", F.lit("url does not match ref").alias("problem"))
    return hit_violations(hits, n).unionByName(long).unionByName(wrong)


def search_report(builds: DataFrame, evals: DataFrame) -> DataFrame:
    """One row per build and setting; a build without a result keeps its error. builds: build, settings array, error."""
    settings = builds.select("build", "bytes", F.explode_outer("settings").alias("setting"), "error")
    return settings.join(evals, ["build", "setting"], "left")


def evaluation_report(found: DataFrame, truth: DataFrame, timings: DataFrame, groups: DataFrame, ks: Sequence[int] = (24, 10)) -> DataFrame:
    """One row per setting and query group: queries, recall at each k, median and 95th percentile of the time.

    found: setting, q, row_id, rank; truth: q, row_id, rank; timings: setting, q, ms (every query that was run); groups: q, grp.
    """
    per_query = timings.join(groups, "q")
    for k in ks:
        wanted = truth.filter(F.col("rank") <= k).select("q", "row_id")
        hits = found.filter(F.col("rank") <= k).join(wanted, ["q", "row_id"]).groupBy("setting", "q").agg((F.count(F.lit(1)) / F.lit(float(k))).alias(f"_r{k}"))
        per_query = per_query.join(hits, ["setting", "q"], "left")
    out = per_query.groupBy("setting", "grp").agg(
        F.count(F.lit(1)).alias("n_queries"), *[F.avg(F.coalesce(f"_r{k}", F.lit(0.0))).alias(f"recall_{k}") for k in ks])
    times = exact_percentiles(per_query, ["setting", "grp"], ["ms"], [0.5, 0.95]).groupBy("setting", "grp").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{round(100 * p)}_ms") for p in (0.5, 0.95)])
    return out.join(times, ["setting", "grp"], "left")  # without times where nothing was timed
