"""Blocks of vectors as binary cells, and the meeting of query blocks with data blocks.

Both sides are packed in tasks. Query blocks of at most ``BROADCAST_BYTES`` together are broadcast by the join, so that data stay where they
are; beyond that, data and queries meet on a grid of lanes (of data) and sides (of queries): data are shuffled once per side,
queries once per lane, and a cell streams its data past the queries of one side. A task keeps the k best rows per query. Lanes come from the bytes
of a key's data, so that there are no more cells, and no more copies of a query and of its best rows, than the data and the cores need.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedmap.operators.ordering import limit_per_group

#: Values in a block of data and in one of queries.
DATA_VALUES, QUERY_VALUES = 1 << 19, 1 << 18
#: Query blocks that are broadcast, and query blocks of one side of the grid.
BROADCAST_BYTES = 2 << 20
SIDE_BLOCKS = 32
#: Data of one lane of the grid at most, and cells per core at least, as far as there are blocks for them.
LANE_BYTES = 64 << 20
CORE_CELLS = 3
#: Row group of stored blocks.
GROUP_BYTES = 8 << 20
#: Scores held at once, and best rows that a task keeps before it hands them on, which also bounds the queries of one side.
SCORE_VALUES = 1 << 20
KEPT_ROWS = 1 << 20
#: Room for the rounding of scores when candidates are told from the rest.
MARGIN = 2e-6
DIGITS = 6

HITS = T.StructType([T.StructField("q", T.LongType()), T.StructField("row_id", T.LongType()), T.StructField("score", T.DoubleType())])

Score = Callable[[object, np.ndarray, np.ndarray], np.ndarray]


def pack(rows: DataFrame, matrix: Callable[[pa.Array], np.ndarray], values: int, on: str | None = None) -> DataFrame:
    """(id, vector) or (id, vector, ``on``) rows as blocks (key, block, ids, data) of one ``on`` value each, packed where the rows are.

    ``matrix`` turns the vector column into rows of numbers of the type to store; ``data`` are its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}

        def block(key: int) -> pa.RecordBatch:
            nonlocal number
            ids, data = (np.concatenate(c) for c in zip(*held.pop(key)))
            del sizes[key]
            number += 1
            return pa.record_batch([pa.array([key], pa.int64()), pa.array([number]), pa.array([ids.astype("<i8").tobytes()]), pa.array([np.ascontiguousarray(data).tobytes()])],
                                   names=["key", "block", "ids", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, m = b.column(0).to_numpy(), matrix(b.column(1))
            keys = b.column(2).to_numpy() if on else np.zeros(len(ids), np.int64)
            order = np.argsort(keys, kind="stable") if on else slice(None)
            ids, m, keys = ids[order], m[order], keys[order]
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist()
            for at, to in zip(edges[:-1], edges[1:]):
                key = int(keys[at])
                while at < to:
                    n = min(to - at, max(1, (values - sizes.get(key, 0)) // m.shape[1]))
                    held.setdefault(key, []).append((ids[at:at + n], m[at:at + n]))
                    sizes[key] = sizes.get(key, 0) + n * m.shape[1]
                    at += n
                    if sizes[key] + m.shape[1] > values:
                        yield block(key)
            if sum(sizes.values()) > 8 * values:
                for key in list(held):
                    yield block(key)
        for key in list(held):
            yield block(key)

    columns = [c for c in rows.columns if c != on]
    source = rows.select(F.col(columns[0]).cast("long"), F.col(columns[1]), *([F.col(on).cast("long")] if on else []))
    return source.mapInArrow(run, "key long, block long, ids binary, data binary")


def write(blocks: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> None:
    """Store blocks. A cell is large, so the size of a row group is looked at after every few rows; otherwise a writer would hold a hundred blocks."""
    stored = blocks.write.mode("errorifexists").option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 2)
    stored.option("parquet.block.size.row.check.max", 4).option("parquet.page.size.row.check.min", 1).option("parquet.enable.dictionary", "false").parquet(path)


class TopRows:
    """k best rows (score descending, row ascending) of every query of a block."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.best = np.full((len(ids), k), -np.inf)
        self.rows = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, s: np.ndarray) -> None:
        """Scores (queries x rows), not rounded yet."""
        bar = self.best[:, -1] - MARGIN
        hot = s >= bar[:, None]
        many = np.flatnonzero(hot.sum(axis=1) > 4 * self.k + 64)
        if len(many) and s.shape[1] > self.k:
            kth = np.partition(s[many], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            hot[many] &= s[many] >= np.maximum(kth - 2 * MARGIN, bar[many])[:, None]
        q, r = np.nonzero(hot)
        if not len(q):
            return
        score = np.concatenate([self.best.ravel(), np.round(s[q, r], DIGITS) + 0.0])
        row = np.concatenate([self.rows.ravel(), rows[r]])
        which = np.concatenate([np.repeat(np.arange(len(self.ids)), self.k), q])
        order = np.lexsort((row, -score, which))
        which = which[order]
        first = np.searchsorted(which, np.arange(len(self.ids)))
        keep = order[np.arange(len(which)) - first[which] < self.k]
        self.best, self.rows = score[keep].reshape(-1, self.k), row[keep].reshape(-1, self.k)

    def batch(self) -> pa.RecordBatch:
        real = self.best > -np.inf
        return pa.record_batch([pa.array(np.repeat(self.ids, real.sum(axis=1))), pa.array(self.rows[real]), pa.array(self.best[real])], names=["q", "row_id", "score"])


class _Searches:
    """Query blocks met so far in a task, and what they found."""

    def __init__(self, score: Score, k: int, kind: str):
        self.score, self.k, self.kind = score, k, kind
        self.found: dict[int, tuple[np.ndarray, TopRows]] = {}

    def block(self, number: int, ids: bytes, data: bytes) -> None:
        if number not in self.found:
            names = np.frombuffer(ids, "<i8")
            self.found[number] = np.frombuffer(data, np.float64).reshape(len(names), -1), TopRows(names, self.k)

    def meet(self, number: int, key: object, ids: np.ndarray, data: np.ndarray) -> None:
        q, top = self.found[number]
        step = max(1, SCORE_VALUES // len(q))
        for at in range(0, len(ids), step):
            top.add(ids[at:at + step], self.score(key, q, data[at:at + step]))

    def full(self) -> bool:
        return sum(len(t.ids) for _, t in self.found.values()) * self.k > KEPT_ROWS

    def batches(self) -> Iterator[pa.RecordBatch]:
        for _, top in self.found.values():
            yield top.batch()
        self.found = {}

    def rows(self, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        names = np.frombuffer(ids, "<i8")
        return names, np.frombuffer(data, self.kind).reshape(len(names), -1)


def sides_of(asked: DataFrame, k: int) -> DataFrame:
    """Sides of every key: as many as bound the query blocks and the best rows of one side."""
    n, kept = F.count(F.lit(1)), F.sum(F.length("ids") / 8) * k
    return asked.groupBy("key").agg(F.greatest(F.ceil(n / SIDE_BLOCKS), F.least(F.ceil(kept / KEPT_ROWS), n)).alias("sides"))


def cells_of(data: DataFrame, asked: DataFrame, k: int, lanes: int | None = None) -> DataFrame:
    """Lanes and sides of every key that has data and queries; one row per key passes the driver.

    A lane holds at most ``LANE_BYTES``, and less where that would leave cores without a cell. A query is sent to every lane of its keys, so the
    number of lanes follows the data and not the number of shuffle partitions.
    """
    spark = data.sparkSession
    held = data.groupBy("key").agg(F.sum(F.length("ids") + F.length("data")).alias("bytes"), F.count(F.lit(1)).alias("blocks"))
    found = held.join(F.broadcast(sides_of(asked, k)), "key").collect()
    spread = sum(r.bytes * r.sides for r in found) / (CORE_CELLS * spark.sparkContext.defaultParallelism)
    size = max(1, min(LANE_BYTES, spread))
    rows = [(r.key, lanes or min(r.blocks, math.ceil(r.bytes / size)), r.sides) for r in found]
    return spark.createDataFrame(rows, "key long, lanes long, sides long")


def nearest(data: DataFrame, asked: DataFrame, k: int, score: Score, kind: str, lanes: int | None = None) -> DataFrame:
    """q, row_id, score, rank of the k best rows of every query. ``data`` and ``asked``: key, block, ids, data; only blocks of one key meet.
    ``asked`` is read several times, so pass it stored.

    ``kind`` is the number type of the data blocks (queries are doubles); ``score`` (key, queries, rows) gives a matrix of scores.
    """
    size = asked.agg(F.coalesce(F.sum(F.length("ids") + F.length("data")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        named = asked.select("key", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = _Searches(score, k, kind)
            for b in batches:
                for i in range(b.num_rows):
                    key, ids, data_, number, q_ids, q_data = (b.column(c)[i] for c in range(6))
                    if number.as_py() not in s.found:
                        s.block(number.as_py(), q_ids.as_py(), q_data.as_py())
                    s.meet(number.as_py(), key.as_py(), *s.rows(ids.as_buffer(), data_.as_buffer()))
                if s.full():
                    yield from s.batches()
            yield from s.batches()

        met = data.select("key", "ids", "data").join(F.broadcast(named), "key").select("key", "ids", "data", "q_block", "q_ids", "q_data")
        hits = met.mapInArrow(near, HITS)
    else:
        cells = F.broadcast(cells_of(data, asked, k, lanes))
        spread = F.xxhash64("block")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        here = data.join(cells, "key").select("key", F.pmod(spread, "lanes").alias("lane"), upto(F.col("sides")).alias("side"), F.lit(1).alias("kind"), "block", "ids", "data")
        there = asked.join(cells, "key").select("key", upto(F.col("lanes")).alias("lane"), F.pmod(spread, "sides").alias("side"), F.lit(0).alias("kind"), "block", "ids", "data")
        cell = ["key", "lane", "side"]

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, current = _Searches(score, k, kind), None
            for b in batches:
                for i in range(b.num_rows):
                    key, lane, side, is_data, number, ids, data_ = (b.column(c)[i] for c in range(7))
                    where = key.as_py(), lane.as_py(), side.as_py()
                    if where != current:
                        yield from s.batches()
                        current = where
                    if is_data.as_py() == 0:
                        s.block(number.as_py(), ids.as_py(), data_.as_py())
                    else:
                        names, rows = s.rows(ids.as_buffer(), data_.as_buffer())
                        for n in s.found:
                            s.meet(n, where[0], names, rows)
            yield from s.batches()

        grid = here.unionByName(there).repartition(*cell).sortWithinPartitions(*cell, "kind", "block")
        hits = grid.select(*cell, "kind", "block", "ids", "data").mapInArrow(stream, HITS)
    return limit_per_group(hits, ["q"], [F.desc("score"), "row_id"], k)


def above(data: DataFrame, asked: DataFrame, score: Score, kind: str) -> DataFrame:
    """(q, row_id) of all rows whose score reaches the bar of a query, which is the last number of its vector in ``asked``. Rows as in ``nearest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, ids, data_, q_ids, q_data = (b.column(c)[i] for c in range(5))
                rows, names = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(q_ids.as_buffer(), "<i8")
                values = np.frombuffer(data_.as_buffer(), kind).reshape(len(rows), -1)
                q = np.frombuffer(q_data.as_buffer(), np.float64).reshape(len(names), -1)
                step = max(1, SCORE_VALUES // len(names))
                for at in range(0, len(rows), step):
                    n, r = np.nonzero(score(key.as_py(), q[:, :-1], values[at:at + step]) >= q[:, -1:])
                    if len(n):
                        yield pa.record_batch([pa.array(names[n]), pa.array(rows[at:at + step][r])], names=["q", "row_id"])

    size = asked.agg(F.coalesce(F.sum(F.length("ids") + F.length("data")), F.lit(0))).first()[0]
    named = asked.select("key", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    met = data.select("key", "ids", "data").join(F.broadcast(named) if size <= BROADCAST_BYTES else named, "key")
    return met.select("key", "ids", "data", "q_ids", "q_data").mapInArrow(run, "q long, row_id long")


def wanted_keys(asked: DataFrame) -> Sequence[int]:
    """Distinct keys of query blocks, for a filter that reaches a scan; at most one per list of the model."""
    return sorted(r[0] for r in asked.select("key").distinct().collect())
