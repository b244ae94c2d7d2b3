"""Packing token sequences into windows by multiway differencing.

``pack`` turns every text into ids and cuts them into pieces of windows of ``window`` ids. A text gives as many full
windows as fit; the tails are gathered per task in batches of about ``batch_tokens`` ids, and each batch is divided by
Karmarkar-Karp differencing: partial partitions start with one tail each, the two with the largest imbalance are merged
with opposing imbalances (heaviest slot on lightest slot), and so on until one is left. If its heaviest window exceeds the
capacity, the number of windows rises by one and the batch is divided again.

There is no shuffle: a task packs the rows of its own input split, so no key can make it uneven, and a lost executor only
repeats its own splits. A task holds one Arrow batch of texts and one batch of tails.

Defined cases: null and empty texts consist of the end id alone; repeated rows are packed once each; a null id stays
null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from embedmap.llm.words import slices, split_words, texts

WINDOW = 4096
BATCH_TOKENS = 1 << 20
END_ID = 2
#: Texts are tokenised in parts of about so many characters, cut at white space.
PART_CHARS = 4 << 20
#: Pieces of words that a worker's cache holds before it is emptied.
CACHE_PIECES = 700_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Words with other characters, an apostrophe or the start of a special token go to the tokenizer as they are.
_OTHER = re.compile("[^!-&(-~¡-©«-±´¶-¸»¿-ÿ]|<[|]")
# The pieces of a lower-case Latin-1 word; a line end separates words.
_PIECES = re.compile("[a-zß-öø-ÿ]+|\n|[0-9]|[^a-zß-öø-ÿ0-9\n]+")


class WordEncoder:
    """Ids of whole texts from a tokenizer whose words never cross white space, with a cache per piece of a word."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.cache_pieces = cache_pieces
        self.clear()

    def clear(self) -> None:
        # Piece number 0 is the separator; the others lie in ``flat`` from ``starts`` on.
        self.known: dict[str, int] = {"\n": 0}
        self.starts, self.lengths, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row and the number of each; the last id of a piece is one that closes a word."""
        ids = np.array(self.plain(" ".join(pieces)), np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(pieces):
            return ids, np.diff(ends, prepend=0)
        each = [self.plain(p) for p in pieces]
        return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def _learn(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.known), len(pieces)
        self.known.update(zip(pieces, range(n, n + m)))
        self.starts, self.lengths, self.flat = _room(self.starts, n, m), _room(self.lengths, n, m), _room(self.flat, self.used, len(ids))
        self.lengths[n:n + m] = lengths
        self.starts[n:n + m] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def _pieces(self, words: list[str]) -> list[str]:
        """Pieces of the words with a separator between words; a word that can't be split here is one piece."""
        joined = "\n".join(words)
        if _OTHER.search(joined.replace("\n", "")) is None:
            return _PIECES.findall(joined.lower())
        out: list[str] = []
        for w in words:
            out += [w] if _OTHER.search(w) else _PIECES.findall(w.lower())
            out.append("\n")
        return out[:-1]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of the column."""
        distinct, codes, bounds = split_words(column)
        pieces = self._pieces(distinct.to_numpy(zero_copy_only=False).tolist())
        numbers = list(map(self.known.get, pieces))
        new = list({p: None for p, number in zip(pieces, numbers) if number is None})
        if new:
            if len(self.known) + len(new) > self.cache_pieces:
                self.clear()
                new = [p for p in dict.fromkeys(pieces) if p != "\n"]
            for k in range(0, len(new), 2000):
                some = new[k:k + 2000]
                self._learn(some, *self._ids_of(some))
            numbers = list(map(self.known.__getitem__, pieces))
        at = np.array(numbers, np.int64)
        real = at > 0
        word = np.cumsum(~real)[real]  # word of each piece
        at = at[real]
        of_piece = self.lengths[at]
        lengths = np.bincount(word, of_piece, len(distinct)).astype(np.int64)
        flat = _spans(self.flat, self.starts[at], of_piece)  # ids of the distinct words in a row
        starts = np.cumsum(lengths) - lengths
        ids = _spans(flat, starts[codes], lengths[codes])
        to = np.concatenate([[0], np.cumsum(lengths[codes])])[bounds]
        for i in range(len(column)):
            yield ids[to[i]:to[i + 1]]

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of one text, part by part."""
        return np.concatenate([ids for p in parts(text) for ids in self.encode(pa.array([p], pa.large_string()))])


def _spans(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The given spans of ``values`` one after another."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    grown = np.zeros(max(used + more, 2 * len(array)), array.dtype)
    grown[:used] = array[:used]
    return grown


def parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``limit`` characters; every cut is at a space, tab or line end."""
    start, space = 0, re.compile("[ \t\n\r]")
    while len(text) - start > limit:
        cut = space.search(text, start + limit)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each item by Karmarkar-Karp multiway differencing."""
    n = len(sizes)
    if windows == 1:
        return np.zeros(n, np.int64)
    sums: list[np.ndarray] = []
    heap = []
    for i, s in enumerate(sizes.tolist()):
        first = np.zeros(windows, np.int64)
        first[0] = s
        sums.append(first)
        heap.append((-s, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        together = sums[a] + sums[b][::-1]
        sums[a] = sums[b] = None
        order = np.argsort(-together, kind="stable")
        together = together[order]
        together -= together[-1]
        merges.append((a, b, order))
        sums.append(together)
        heapq.heappush(heap, (-int(together[0]), len(sums) - 1))
    slots: dict[int, np.ndarray] = {len(sums) - 1: np.arange(windows)}
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        place = np.empty(windows, np.int64)
        place[order] = slots.pop(node)
        slots[a], slots[b] = place, place[::-1]
    return np.array([slots[i][0] for i in range(n)], np.int64)


def near_equal(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of at most ``capacity`` each; their number rises until no window is too full."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        slot = differencing(sizes, windows)
        if np.bincount(slot, sizes, windows).max() <= capacity:
            return slot
        windows += 1


class Packer:
    """Pieces of one task: full windows at once, tails in batches."""

    def __init__(self, window: int, batch_tokens: int, first_sequence: int):
        self.window, self.batch_tokens, self.sequence = window, batch_tokens, first_sequence
        self.tails: list[tuple] = []
        self.waiting = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        for start in range(0, n, self.window):
            piece = ids[start:start + self.window]
            row = (doc, start, len(piece), zlib.crc32(np.ascontiguousarray(piece, "<u4").data), n)
            if len(piece) == self.window:
                self.out.append((*row, self.sequence, 0))
                self.sequence += 1
            else:
                self.tails.append(row)
                self.waiting += len(piece)
        if self.waiting >= self.batch_tokens:
            self.close()

    def close(self) -> None:
        if not self.tails:
            return
        slot = near_equal(np.array([t[2] for t in self.tails], np.int64), self.window)
        filled = np.zeros(int(slot.max()) + 1, np.int64)
        names = np.full(len(filled), -1, np.int64)
        for row, s in zip(self.tails, slot.tolist()):
            if names[s] < 0:
                names[s] = self.sequence
                self.sequence += 1
            self.out.append((*row, int(names[s]), int(filled[s])))
            filled[s] += row[2]
        self.tails, self.waiting = [], 0

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}  # one per Python worker, kept between its tasks


def _kernel(path: str, window: int, batch_tokens: int, end_id: int, slice_chars: int = PART_CHARS, cache_pieces: int = CACHE_PIECES):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (path, cache_pieces) not in _ENCODERS:
            _ENCODERS[path, cache_pieces] = WordEncoder(path, cache_pieces)
        encoder = _ENCODERS[path, cache_pieces]
        packer = Packer(window, batch_tokens, TaskContext.get().partitionId() << 40)
        schema = pa.schema([(n, pa.int64()) for n in names])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        for b in batches:
            docs = b.column(0).to_pylist()
            for first, some in slices(texts(b.column(1)), slice_chars):
                long = len(some) == 1 and pc.binary_length(some[0]).as_py() > PART_CHARS
                for i, ids in enumerate([encoder.encode_long(some[0].as_py())] if long else encoder.encode(some)):
                    packer.add(docs[first + i], np.append(ids, np.uint32(end_id)))
                if len(packer.out) >= 10_000:
                    yield batch(packer.take())
        packer.close()
        if packer.out:
            yield batch(packer.take())

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, batch_tokens: int = BATCH_TOKENS, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", slice_chars: int = PART_CHARS, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Pieces of all texts: id, start among the text's ids, length, checksum of the ids, ids of the text, window, offset there.

    ``slice_chars`` of texts are encoded at once and ``cache_pieces`` remembered; both trade memory for time and change no row.
    """
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        _kernel(tokenizer, window, batch_tokens, end_id, slice_chars, cache_pieces), SCHEMA)
