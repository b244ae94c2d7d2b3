"""Exact top-k search by no-random-access aggregation over sorted lists.

Vectors lie in blocks; a block keeps one list per dimension, sorted by value. A query reads each list from its better end
(the top for a positive weight, the bottom for a negative one), all lists to the same depth. What a row has shown so far
plus the worst value of each list it hasn't shown in is its lower bound, plus the value at the reading edge its upper
bound. Reading stops when the k-th best lower bound (of this block or of blocks read before) exceeds both the bound of rows
not seen at all and leaves few rows above it; their scores are then resolved. A block whose list heads can't reach the
bound isn't read.

Query blocks of bounded size meet lanes of data blocks: data are sent once per query block (one for up to ``QUERY_VALUES`` values of
queries), and a task streams its lane past one query block and returns the k best of each query and block, so nothing grows with
the number of candidates of a query.

Defined cases: a vector that is null, empty or holds a null, NaN or infinite component takes no part; an id that is null takes no
part; every row is a candidate, so an id with several rows can be found once for each; a query is not compared with rows of its own id,
and a query id with several rows has the best of all of them; vectors of different lengths have no score together; equal scores go to
the smaller id; an empty table gives no rows; other columns are ignored. Scores are exact below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedmap.llm.tables import stored

BLOCK_ROWS = 4096
QUERY_VALUES = 1 << 22
#: Reading depths at which the bounds are looked at, as shares of a list: doubling from the head, so that all looks together cost about two of the last.
DEPTHS = (*(2.0 ** -i for i in range(6, 0, -1)), 0.875)
#: Reading also goes on while more than one in so many rows of the block can still qualify.
FEW = 4


class Lists:
    """The sorted lists of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()  # one row per list, ascending
        self.sorted = np.take_along_axis(vectors, self.order.T, axis=0).T.copy()

    def best(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the block's k best for the query that reach ``floor``, best first."""
        n, used = len(self.ids), np.flatnonzero(query)
        weight = query[used]
        up = weight > 0
        head = np.where(up, self.sorted[used, -1], self.sorted[used, 0]) * weight
        if head.sum() < floor:
            return np.zeros(0, np.int64), np.zeros(0)
        if not len(used):
            return self._resolve(np.arange(n), query, own, k, floor)
        worst = np.where(up, self.sorted[used, 0], self.sorted[used, -1]) * weight
        others = self.ids != own
        lower, read = np.full(n, worst.sum()), 0
        seen: list[np.ndarray] = []  # rows shown by each list, one array per stretch read
        for share in DEPTHS:
            depth = int(n * share)
            if depth <= read:
                continue
            rows, shown = self._read(used, up, weight, read, depth)
            edge, read = shown[:, -1], depth
            seen.append(rows)
            lower += np.bincount(rows.ravel(), (shown - worst[:, None]).ravel(), n)
            if np.count_nonzero(others) >= k:
                floor = max(floor, np.partition(lower[others], -k)[-k])
            if edge.sum() >= floor:  # a row not seen at all can still qualify, so there is no need to look at the others
                continue
            left = np.flatnonzero(self._above(lower, seen, edge - worst) >= floor)
            if len(left) <= n // FEW:
                return self._resolve(left, query, own, k, floor)
        left = np.flatnonzero(self._above(lower, seen, edge - worst) >= floor) if seen else np.arange(n)
        return self._resolve(left, query, own, k, floor)

    @staticmethod
    def _above(lower: np.ndarray, seen: list[np.ndarray], room: np.ndarray) -> np.ndarray:
        """Upper bounds: the edge of every list, but for those in which the row was shown."""
        above = lower + room.sum()
        for part in seen:
            above -= np.bincount(part.ravel(), np.repeat(room, part.shape[1]), len(lower))
        return above

    def _read(self, used, up, weight, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        rows = np.empty((len(used), end - start), np.int64)
        shown = np.empty((len(used), end - start))
        tops, bottoms = used[up], used[~up]
        rows[up] = self.order[tops, n - end:n - start][:, ::-1]
        shown[up] = self.sorted[tops, n - end:n - start][:, ::-1]
        rows[~up] = self.order[bottoms, start:end]
        shown[~up] = self.sorted[bottoms, start:end]
        shown *= weight[:, None]
        return rows, shown

    def _resolve(self, rows: np.ndarray, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != own]
        scores = self.vectors[rows] @ query
        reach = scores >= floor
        rows, scores = rows[reach], scores[reach]
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]


def _in_blocks(rows: int, limit: int):
    """Rows (dim, id, vector) of a partition as blocks of one length of vector each, of at most ``rows`` rows and ``limit`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, parts: list) -> pa.RecordBatch:
            ids, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())],
                                   names=["dim", "ids", "data"])

        for b in batches:
            dims = b.column(0).to_numpy()
            ids = b.column(1).to_numpy()
            flat, ends = b.column(2).flatten().to_numpy(), np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                most = max(1, min(rows, limit // dim))
                own = np.flatnonzero(dims == dim)
                values = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                at = 0
                while at < len(own):
                    parts = waiting.setdefault(dim, [])
                    room = most - sum(len(p[0]) for p in parts)
                    parts.append((ids[own[at:at + room]], values[at:at + room]))
                    at += room
                    if at <= len(own):
                        yield block(dim, waiting.pop(dim))
        for dim, parts in waiting.items():
            yield block(dim, parts)

    return run


def _search(k: int):
    """Rows (query_block, lane, is_data, dim, ids, data) in this order, queries before data, to the k best of each query and data block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, asked, weights, floors = None, None, None, {}
        for b in batches:
            for i in range(b.num_rows):
                number, lane, is_data, dim, ids, data = (b.column(c)[i] for c in range(6))
                ids, values = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.float64).reshape(-1, dim.as_py())
                if not is_data.as_py():
                    where, asked, weights, floors = number.as_py(), ids.tolist(), values.copy(), {}
                    continue
                assert where == number.as_py(), "data without their queries"
                lists = Lists(ids, values)
                found: list[list[np.ndarray]] = [[], [], []]
                for own, query in zip(asked, weights):
                    rows, scores = lists.best(query, own, k, floors.get(own, -np.inf))
                    if len(rows) == k:
                        floors[own] = max(floors.get(own, -np.inf), scores[-1])
                    for to, some in zip(found, (np.full(len(rows), own), ids[rows], scores.astype(np.int64))):
                        to.append(some)
                yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(dim, vec_id, vector) of the usable rows: floor(scale * x) as whole doubles."""
    x = F.transform(vectors[vector_col], lambda v: v.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), x.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter((F.size("v") > 0) & F.forall(
        "v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    return rows.select(F.size("v").alias("dim"), "vec_id", F.transform("v", lambda v: F.floor(v * F.lit(float(scale))).cast("double")).alias("vector"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
          block_rows: int = BLOCK_ROWS, query_values: int = QUERY_VALUES) -> DataFrame:
    """The k best other vectors of every query by integer inner product: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the id column.
    """
    spark = vectors.sparkSession
    shape = "dim int, ids binary, data binary"
    usable = quantised(vectors.withColumnRenamed(id_col, "vec_id"), scale, "vec_id", vector_col)
    data = stored(usable.mapInArrow(_in_blocks(block_rows, 1 << 40), shape).withColumn("block", F.monotonically_increasing_id()))
    asked = quantised(vectors.withColumnRenamed(id_col, "vec_id").filter(is_query), scale, "vec_id", vector_col)
    values = asked.agg(F.sum("dim")).first()[0] or 0
    # As few query blocks as their size allows: data are sent once per block.
    asked = stored(asked.coalesce(max(1, -(-values // query_values))).mapInArrow(_in_blocks(1 << 40, query_values), shape)
                   .withColumn("query_block", F.monotonically_increasing_id()))
    lanes = max(1, min(data.count(), 4 * spark.sparkContext.defaultParallelism))
    columns = ["query_block", "lane", "is_data", "dim", "ids", "data"]
    left = data.withColumns({"lane": F.pmod(F.xxhash64("block"), F.lit(lanes)), "is_data": F.lit(True)})
    left = left.join(F.broadcast(asked.select("dim", "query_block")) if asked.count() <= 100_000 else asked.select("dim", "query_block"), "dim")
    right = asked.withColumns({"lane": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))), "is_data": F.lit(False)})
    met = left.select(columns).unionByName(right.select(columns)).repartition("query_block", "lane").sortWithinPartitions("query_block", "lane", "is_data")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
