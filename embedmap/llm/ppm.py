"""Scores of texts under prediction by partial matching with a byte-context trie, beside an add-one unigram base.

A text is its words (A-Z lower-cased, runs of ``[^\\x20\\x09-\\x0D]``) joined by one space and closed by an end byte. The model is the
trie of byte contexts of up to ``ORDER`` bytes, trained on the rows that are not held out: at the deepest level a symbol counts as
often as it followed its context, at a level above once for every longer context in which it was new (update exclusion). The
escape from a context takes half a count from each of its symbols; symbols that a longer context has offered are excluded from the
shorter ones; below the empty context all remaining byte values are equally likely. So the probabilities of what may follow add up to 1.

How it runs: rows are filed in chunks of bounded size with the distinct (context, symbol) pairs and words of each chunk and their
training counts. Pairs are added up over all chunks; the trie is partitioned by the last two bytes of the context, so that a
partition holds whole subtrees and needs no more than the first levels (at most 65,536 pairs, from the driver) besides; a task
scores its pairs level by level. Scores and word counts then go back to the chunks that hold them, never to a row or a
window each, and the rows of a chunk add up their scores. No table of the model is broadcast or collected but the first levels.

Defined cases: a null or empty text is its end alone; rows are held out by the given column, null counting as false; repeated rows count and are
scored each; without training rows every byte has probability 1/256 and every token of the base 1; an empty table gives no
rows; a very long text is a chunk of its own. Other columns pass through untouched, whatever their names; the text column is
replaced by struct ``_lm``, to which a column of that name gives way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedmap.llm.tables import stored
from embedmap.llm.words import signed

ORDER = 5
#: Bytes of text in a chunk, and in the stretch that is turned into pairs at once.
CHUNK_BYTES = 64 << 20
STRETCH_BYTES = 4 << 20
#: Pairs that a task scores at once (whole groups of contexts).
BLOCK_PAIRS = 1 << 20
#: Rows that a task packs at once for the chunks.
PACKED_ROWS = 1 << 22

END = b"\n"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PAIR, _WORD, _DOC = range(3)
_TABLE = "chunk long, kind int, body binary"


def word_lists(data: bytes, limit: int = STRETCH_BYTES) -> Iterator[list[bytes]]:
    """Words of a text, in runs of about ``limit`` bytes."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + limit) if at + limit < len(data) else None
        to = cut.start() if cut else len(data)
        words = data[at:to].translate(_LOWER).split()
        if words:
            yield words
        at = to


def body_of(data: bytes) -> bytes:
    return b" ".join(b" ".join(w) for w in word_lists(data)) + END


def pair_codes(bodies: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of context and symbol (a byte each, the symbol last) at every byte of the bodies, and where each body begins."""
    lead = END * order
    sizes = np.array([len(b) for b in bodies], np.int64)
    data = np.frombuffer(lead + lead.join(bodies), np.uint8)
    n = len(data) - order
    code = np.zeros(n, np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | data[k:k + n]
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    take = np.ones(n, bool)
    starts = begins + order * np.arange(len(bodies))
    for k in range(1, order + 1):  # bytes of the next body's lead are no symbols
        take[starts[1:] - k] = False
    return code[take], begins


def stretches(bodies: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = weight = 0
    for i, b in enumerate(bodies):
        weight += len(b)
        if weight > STRETCH_BYTES or i == len(bodies) - 1:
            yield at, bodies[at:i + 1]
            at, weight = i + 1, 0


class _Chunk:
    """Distinct pairs and words of a chunk with their training counts."""

    def __init__(self, order: int):
        self.order, self.bytes = order, 0
        self.words: Counter = Counter()
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def take(self, bodies: list[bytes], learned: list[bool]) -> None:
        for train in (True, False):
            some = [b for b, t in zip(bodies, learned) if t is train]
            for _, part in stretches(some):
                found, distinct = pd.factorize(pair_codes(part, self.order)[0])
                n = np.bincount(found, minlength=len(distinct)) if train else np.zeros(len(distinct), np.int64)
                codes, place = np.unique(np.concatenate([self.codes, distinct]), return_inverse=True)
                self.counts = np.bincount(place, np.concatenate([self.counts, n]), len(codes)).astype(np.int64)
                self.codes = codes
            for b in some:
                for words in word_lists(b):
                    self.words.update(words if train else dict.fromkeys(words, 0))
            self.words[END] += len(some) if train else 0
        self.bytes += sum(map(len, bodies))


def _file(order: int, limit: int):
    """Rows (row, learned, text) to the rows of their chunks, with packed bodies, and the chunks' pairs and words."""
    names = ["chunk", "kind", "row", "body", "code", "n", "word"]
    kinds = [pa.int64(), pa.int32(), None, pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def batch(chunk: int, kind: int, size: int, **given) -> pa.RecordBatch:
        given |= {"chunk": pa.array(np.full(size, chunk)), "kind": pa.array(np.full(size, kind, np.int32))}
        return pa.record_batch([given[c] if c in given else pa.nulls(size, t) for c, t in zip(names, kinds)], names=names)

    def ends(chunk: int, c: _Chunk) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(c.codes), 1 << 18):
            some = c.codes[at:at + (1 << 18)]
            yield batch(chunk, _PAIR, len(some), code=pa.array(signed(some)), n=pa.array(c.counts[at:at + (1 << 18)]))
        words = list(c.words.items())
        for at in range(0, len(words), 1 << 16):
            some = words[at:at + (1 << 16)]
            yield batch(chunk, _WORD, len(some), word=pa.array([w for w, _ in some], pa.binary()), n=pa.array([n for _, n in some], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        zip_, number, c = zstandard.ZstdCompressor(level=3), 0, _Chunk(order)
        for b in batches:
            kinds[2] = b.column(0).type
            texts, learned = b.column(2), b.column(1).to_pylist()
            at, bodies = 0, []
            for i in range(b.num_rows):
                bodies.append(body_of(bytes(texts[i].as_py() or b"")))
                weight = sum(map(len, bodies)) if len(bodies) % 64 == 0 or len(bodies[-1]) > STRETCH_BYTES else 0
                if weight > 2 * STRETCH_BYTES or i == b.num_rows - 1:
                    c.take(bodies, learned[at:i + 1])
                    yield batch(base | number, _DOC, len(bodies), row=b.column(0).slice(at, len(bodies)), body=pa.array([zip_.compress(x) for x in bodies], pa.binary()))
                    at, bodies = i + 1, []
                    if c.bytes > limit:
                        yield from ends(base | number, c)
                        number, c = number + 1, _Chunk(order)
        if c.bytes:
            yield from ends(base | number, c)

    return run


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every wanted value in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def _low(codes: np.ndarray, level: int) -> np.ndarray:
    """Pairs with the last ``level`` bytes of the context."""
    return codes & np.uint64((1 << (8 * (level + 1))) - 1)


def _sums(groups: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct groups, with the sum of weights and the number of entries of each."""
    keys, place = np.unique(groups, return_inverse=True)
    return keys, np.bincount(place, weights, len(keys)), np.bincount(place, minlength=len(keys)).astype(float)


def level_up(codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of ``level`` and in how many contexts one byte longer each was seen."""
    return np.unique(_low(codes, level), return_counts=True)


def score_pairs(pairs: np.ndarray, levels: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> np.ndarray:
    """Log10 probability of the symbol of every pair after its context; ``levels`` are sorted pairs and counts by context length."""
    score, open_ = np.zeros(len(pairs)), np.ones(len(pairs), bool)
    eight = np.uint64(8)
    for level in range(order, -1, -1):
        codes, counts = levels[level]
        wanted = _low(pairs, level)
        contexts, totals, symbols = _sums(codes >> eight, counts)
        place, there = _at(contexts, wanted >> eight)
        if not len(contexts):
            continue
        total, kinds = np.where(there, totals[place], 0.0), np.where(there, symbols[place], 0.0)
        if level < order:
            # What the longer context has offered is excluded here; all of it is known here too.
            longer = levels[level + 1][0]
            again = counts[_at(codes, _low(longer, level))[0]]
            contexts, gone, n = _sums(longer >> eight, again)
            place, there = _at(contexts, _low(pairs, level + 1) >> eight)
            if len(contexts):
                total, kinds = total - np.where(there, gone[place], 0.0), kinds - np.where(there, n[place], 0.0)
        place, known = _at(codes, wanted)
        live = open_ & (kinds > 0)
        hit, miss = live & known, live & ~known
        score[hit] += np.log10((counts[place[hit]] - 0.5) / total[hit])
        score[miss] += np.log10(0.5 * kinds[miss] / total[miss])
        open_ &= ~hit
    score[open_] -= np.log10(max(256 - len(levels[0][0]), 1))
    return score


def _score(order: int, first: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Pairs (code, n, tail) in order of their tail (last two context bytes) to (code, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def done(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            by = np.argsort(codes)
            codes, n = codes[by], n[by]
            levels = {order: (codes[n > 0], n[n > 0])}
            for level in range(order - 1, 1, -1):
                levels[level] = level_up(levels[level + 1][0], level)
            values = score_pairs(codes, levels | first, order)
            for at in range(0, len(codes), 1 << 18):
                yield pa.record_batch([pa.array(signed(codes[at:at + (1 << 18)])), pa.array(values[at:at + (1 << 18)])], names=["code", "value"])

        rows = 0
        for b in batches:
            code, n, tail = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()
            if rows >= BLOCK_PAIRS:
                new = np.flatnonzero(tail != held[-1][2][-1])
                if len(new):
                    k = new[0]
                    held.append((code[:k], n[:k], tail[:k]))
                    yield from done(*(np.concatenate(c) for c in list(zip(*held))[:2]))
                    held, rows, code, n, tail = [], 0, code[k:], n[k:], tail[k:]
            held.append((code, n, tail))
            rows += len(code)
        if rows:
            yield from done(*(np.concatenate(c) for c in list(zip(*held))[:2]))

    return run


def _packed(kind: int):
    """(chunk, code, value) or (chunk, word, n) rows to compressed tables of a chunk each, packed where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0

        def table(chunk: int) -> bytes:
            first, second = (np.concatenate(c) for c in zip(*held[chunk]))
            by = np.argsort(first)
            first, second = first[by], second[by]
            # Codes in ascending order are stored as steps; the end token as an empty word.
            data = np.diff(first, prepend=np.uint64(0)).tobytes() if kind == _PAIR else b"\n".join(b"" if w == END else w for w in first.tolist())
            return zip_.compress(len(first).to_bytes(8, "little") + second.tobytes() + data)

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.int64()), pa.array([kind] * len(held), pa.int32()), pa.array([table(c) for c in held], pa.binary())], names=["chunk", "kind", "body"])

        for b in batches:
            chunk = b.column(0).to_numpy()
            first = b.column(1).to_numpy().view(np.uint64) if kind == _PAIR else b.column(1).to_numpy(zero_copy_only=False)
            second = b.column(2).to_numpy()
            order = np.argsort(chunk, kind="stable")
            chunk, first, second = chunk[order], first[order], second[order]
            edges = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])).tolist()
            for at, to in zip(edges[:-1], edges[1:]):
                if to > at:
                    held.setdefault(int(chunk[at]), []).append((first[at:to], second[at:to]))
            rows += b.num_rows
            if rows > PACKED_ROWS:
                yield batch()
                held, rows = {}, 0
        if held:
            yield batch()

    return run


def _unpacked(kind: int, data: bytes) -> tuple:
    n = int.from_bytes(data[:8], "little")
    second, rest = np.frombuffer(data, np.float64 if kind == _PAIR else np.int64, n, 8), data[8 + 8 * n:]
    if kind == _PAIR:
        return np.cumsum(np.frombuffer(rest, np.uint64), dtype=np.uint64), second
    return [w or END for w in rest.split(b"\n")], second.tolist()


def _add_up(order: int, total: int, distinct: int):
    """Rows of chunks, tables before documents, to (row, n_tokens, n_known, base_score, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        chunk, known, values, words, parts = None, None, None, {}, []
        unit = np.log10(total + distinct + 1)

        def scored(rows: pa.Array, bodies: list[bytes]) -> pa.RecordBatch:
            n_tokens, n_known, base = [], [], []
            for b in bodies:
                n = have = 0
                logs = 0.0
                for some in [*word_lists(b), [END]]:
                    counts = np.fromiter(map(words.__getitem__, some), np.int64, len(some))
                    n += len(some)
                    have += int(np.count_nonzero(counts))
                    logs += float(np.log10(counts + 1.0).sum())
                n_tokens.append(n)
                n_known.append(have)
                base.append(logs - n * unit)
            score = []
            for _, some in stretches(bodies):
                codes, begins = pair_codes(some, order)
                found, uniq = pd.factorize(codes)
                score.append(np.add.reduceat(values[np.searchsorted(known, uniq)][found], begins))
            return pa.record_batch([rows, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(score))],
                                   names=["row", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            rows, bodies = b.column(2), []
            ids, kinds = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(b.num_rows):
                if ids[i] != chunk:
                    chunk, known, words, parts = ids[i], None, {}, []
                data = unzip.decompress(b.column(3)[i].as_py())
                if kinds[i] == _PAIR:
                    parts.append(_unpacked(_PAIR, data))
                elif kinds[i] == _WORD:
                    words.update(zip(*_unpacked(_WORD, data)))
                else:
                    if known is None:
                        known, values = (np.concatenate(c) for c in zip(*parts))
                        by = np.argsort(known)
                        known, values, parts = known[by], values[by], []
                    bodies.append(data)
                    last = i == b.num_rows - 1 or ids[i + 1] != chunk
                    if last or len(bodies) >= 512 or len(data) > STRETCH_BYTES:
                        yield scored(rows.slice(i + 1 - len(bodies), len(bodies)), bodies)
                        bodies = []

    return run


def ppm_scores(docs: DataFrame, held_out: Column, text_col: str = "text", into: str = "_lm", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with the text replaced by struct ``into``: held_out, n_tokens, n_known (tokens met in training), train_tokens, base_score and score
    (log10 probabilities of the whole text). ``order`` bytes of context, 3 to 7."""
    if not 3 <= order <= 7:
        raise ValueError("order must be 3 to 7")
    kept = [c for c in docs.columns if c not in (text_col, into)]
    carried = [docs[f"`{c.replace('`', '``')}`"] for c in kept] or [F.lit(0)]
    row = F.struct(F.coalesce(held_out, F.lit(False)).alias("out"), F.struct(*carried).alias("kept"))
    source = docs.select(row.alias("row"), docs[text_col].cast("binary").alias("text")).select("row", (~F.col("row.out")).alias("learned"), "text")
    shape = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("row", source.schema["row"].dataType), T.StructField("body", T.BinaryType()),
                          T.StructField("code", T.LongType()), T.StructField("n", T.LongType()), T.StructField("word", T.BinaryType())])
    filed = stored(source.mapInArrow(_file(order, chunk_bytes), shape), "zstd")
    pairs, words = filed.filter(F.col("kind") == _PAIR).select("chunk", "code", "n"), filed.filter(F.col("kind") == _WORD).select("chunk", "word", "n")
    counted = stored(pairs.groupBy("code").agg(F.sum("n").alias("n")))
    # Levels 1 and 0: at most 65,536 pairs of a byte and the next.
    second = counted.filter(F.col("n") > 0).select(F.col("code").bitwiseAND(0xFFFFFF).alias("code")).distinct()
    top = second.groupBy(F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    one = np.array([r.code for r in top], np.uint64), np.array([r.n for r in top], np.int64)
    first = {1: one, 0: level_up(one[0], 0)}
    tails = counted.select("code", "n", F.shiftright("code", 8).bitwiseAND(0xFFFF).alias("tail")).repartition("tail").sortWithinPartitions("tail")
    values = tails.mapInArrow(_score(order, first), "code long, value double")
    totals = stored(words.groupBy("word").agg(F.sum("n").alias("c")))
    size = totals.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    scored = pairs.select("chunk", "code").join(values.hint("shuffle_hash"), "code").select("chunk", "code", "value")
    named = words.select("chunk", "word").join(totals.hint("shuffle_hash"), "word").select("chunk", "word", "c")
    tables = scored.mapInArrow(_packed(_PAIR), _TABLE).unionByName(named.mapInArrow(_packed(_WORD), _TABLE))
    tables = tables.select("chunk", "kind", F.lit(None).cast(shape["row"].dataType).alias("row"), "body")
    together = tables.unionByName(filed.filter(F.col("kind") == _DOC).select("chunk", "kind", "row", "body")).repartition("chunk").sortWithinPartitions("chunk", "kind")
    out_shape = T.StructType([shape["row"], *[T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))]])
    out = together.mapInArrow(_add_up(order, size.n, size.v), out_shape)
    made = F.struct(F.col("row.out").alias("held_out"), "n_tokens", "n_known", F.lit(size.n).cast("long").alias("train_tokens"), "base_score", "score")
    return out.select(*[F.col("row.kept").getField(c).alias(c) for c in kept], made.alias(into))
