"""Removal of repeated passages: every word in a window of ``window`` words that also starts somewhere else goes.

The reference of a document is the whole corpus, far too large to broadcast. So the reference is cut into shards by content
and documents are sent to the shards that can match them: each window is filed under its anchor, the smallest of its
``GRAM``-word hashes (leftmost if equal), so equal windows have equal anchors at equal places. A run of windows with one anchor is a
snippet. Anchors found once can't match anything and stay behind. For the others:

* snippets found twice or more as a whole are repeated as a whole, counted by hash (the anchor's 64 bits and 64 more);
* the other snippets of an anchor are streamed through the suffix automaton of that anchor's distinct snippets: its matching
  statistics tell at every word whether the last ``window`` words occur in two snippets. The maximal spans of such
  windows are removed;
* the automaton of an anchor takes at most ``FORMS`` distinct snippets. A more crowded anchor is split by content: windows with more words left
  of the anchor than the middle of their range share those words and are filed under their hash, the others share the words right of it.
  Equal windows always meet again, a snippet becomes at most two pieces a round, and after five rounds a piece is one window. So every
  snippet meets an automaton (or its equals, by hash) in a shard of bounded size, and no task gathers a crowd.

Defined cases: null texts have no words; documents shorter than a window lose nothing; repeated rows repeat each other's windows
and so go if long enough; rows with a null id are documents like others; an empty table gives no rows; other columns are kept out
of the way whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.llm.tables import stored
from embedmap.llm.words import BASE, mix, raw, rolling, signed, slices, texts, word_hashes

WINDOW = 35
GRAM = 6
#: Distinct snippets that one automaton takes; an anchor with more is split.
FORMS = 500
#: Words whose anchors are found at once (positions fit in 24 bits).
STRETCH = 1 << 22

_KEY = ["doc", "sig"]
_LEAST = -(1 << 63)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive keys."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return keys if have == width else np.minimum(keys[:-(width - have)], keys[width - have:])


def snippets(h: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Document index, first window, windows, anchor, hash and words before the anchor of every run of windows with one anchor."""
    out = []
    powers, undo = _powers(BASE, min(len(h), STRETCH + window)), _powers(_INVERSE, min(len(h), STRETCH + window))
    for at in range(0, len(h), STRETCH):
        part = h[at:at + STRETCH + window - 1]
        if len(part) < window:
            break
        grams = mix(rolling(part, GRAM))
        position = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 24) - 1)
        least = _sliding_least((grams & ~low) | position, window - GRAM + 1)
        anchor = (least & low).astype(np.int64)  # one per window start
        doc = np.searchsorted(bounds, np.arange(at, at + len(anchor)), "right") - 1
        inside = np.arange(at, at + len(anchor)) + window <= bounds[doc + 1]
        first = np.flatnonzero(inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]]))
        last = np.flatnonzero(inside & np.concatenate([(anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[1:], [True]]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[:len(part)], dtype=np.uint64)])
        length = (last - first + window).astype(np.uint64)
        whole = mix((total[last + window] - total[first]) * undo[first] + length)
        out.append((doc[first], first + at - bounds[doc[first]], last - first + 1, grams[anchor[first]], whole, anchor[first] - first))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    return tuple(np.concatenate(c) for c in zip(*out))


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, sigs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for first, some in slices(texts(b.column(2))):
                doc, start, n, anchor, whole, left = snippets(*word_hashes(some), window)
                if len(doc):
                    yield pa.record_batch([pa.array(signed(anchor)), pa.array(signed(whole)), pa.array(docs[first + doc]), pa.array(sigs[first + doc]),
                                           pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(left.astype(np.int32))],
                                          names=["anchor", "whole", "doc", "sig", "start", "windows", "left"])

    return run


def _snippet_texts(window: int):
    """Rows (doc, sig, text, refs) to one row per snippet, with its words joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "doc", "sig", "start", "windows", "left", "single", "crowded", "words"]
        for b in batches:
            for doc, sig, text, refs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                words = raw(text.as_py()).split()
                rows = [[r["anchor"], doc, sig, r["start"], r["windows"], r["left"], r["single"], r["crowded"],
                         b" ".join(words[r["start"]:r["start"] + r["windows"] + window - 1])] for r in refs.as_py()]
                kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_()] * 2 + [pa.binary()]
                for k in range(0, len(rows), 5000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 5000]), kinds)], names=names)

    return run


class SuffixAutomaton:
    """Suffix automaton of several word sequences with, per state, the number of sequence positions that end in it."""

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
                self.ends[last] += 1
        link, ends = self.link, self.ends
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            ends[link[state]] += ends[state]

    def _add(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(0)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w) -> int:
        """State for the words of ``q`` up to the length that ``p`` can reach, or ``q`` itself."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new = self._add(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def matches(self, words: list, window: int) -> Iterator[tuple[int, int]]:
        """Matching statistics of a text as (first window, last window) spans whose windows end at two places or more."""
        state = matched = 0
        open_at = None
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            repeated = matched >= window and self.ends[state] >= 2
            at = i - window + 1
            if repeated and open_at is None:
                open_at = at
            elif not repeated and open_at is not None:
                yield open_at, at - 1
                open_at = None
        if open_at is not None:
            yield open_at, len(words) - window


def _match(window: int):
    """Snippets sorted by anchor to the spans of their repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "sig", "first", "last"]
        current, group, out = None, [], []

        def spans() -> Iterator[tuple]:
            if len(group) > 1 and any(g[4] for g in group):
                cut = [g[3].split(b" ") for g in group]
                automaton = SuffixAutomaton(cut)
                for (doc, sig, start, _, single), words in zip(group, cut):
                    if single:
                        for a, z in automaton.matches(words, window):
                            yield doc, sig, start + a, start + z

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for b in batches:
            for anchor, *row in zip(*(b.column(c).to_pylist() for c in range(6))):
                if anchor != current:
                    out += spans()
                    current, group = anchor, []
                    if len(out) > 10_000:
                        yield batch(out)
                        out = []
                group.append(row)
        out += spans()
        if out:
            yield batch(out)

    return run


def _halves(window: int):
    """Pieces with ``low`` to ``high`` words of each window left of the anchor, to the pieces of the two halves of that range.

    A piece: key (of the words that its windows are known to share), doc, sig, start (first window), windows, left (words before the anchor), low,
    high, single, words. ``whole`` is the hash of its words.
    """
    around = window - GRAM
    names = ["key", "whole", "doc", "sig", "start", "windows", "left", "low", "high", "single", "words"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 5 + [pa.bool_(), pa.binary()]
    signed_hash = lambda seed, data: xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, doc, sig, start, n, left, low, high, single, text in zip(*(c.to_pylist() for c in b.columns)):
                words, mid = text.split(b" "), (low + high) // 2
                for side, lo, hi in ((0, low, mid), (1, mid + 1, high)):
                    # Window j of the piece has left - j words before the anchor.
                    first, last = max(0, left - hi), min(n - 1, left - lo)
                    if lo <= hi and first <= last:
                        shared = words[left - lo:left] if side else words[left + GRAM:left + GRAM + around - hi]
                        mine = b" ".join(words[first:last + window])
                        known = key.to_bytes(8, "little", signed=True) + bytes([lo, hi, side]) + b" ".join(shared)
                        rows.append([signed_hash(1, known), signed_hash(2, mine), doc, sig, start + first, last - first + 1, left - first, lo, hi, single, mine])
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


_PIECE = "key long, whole long, doc long, sig long, start int, windows int, left int, low int, high int, single boolean, words binary"


def _whole_span() -> tuple[Column, Column]:
    return F.col("start").cast("long").alias("first"), (F.col("start") + F.col("windows") - 1).cast("long").alias("last")


def crowded_spans(pieces: DataFrame, window: int, forms: int) -> list[DataFrame]:
    """Spans of repeated windows among the pieces of crowded keys, which are halved by content until a key's forms fit an automaton."""
    spans = []
    while not pieces.isEmpty():
        cut = stored(pieces.select("key", *_KEY, "start", "windows", "left", "low", "high", "single", "words").mapInArrow(_halves(window), _PIECE))
        counted = stored(cut.groupBy("key", "whole").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("n"), F.min(F.struct(*_KEY, "start")).alias("one")))
        again = counted.filter(F.col("n") > 1).select("key", "whole")
        spans.append(cut.filter("single").join(again, ["key", "whole"], "left_semi").select(*_KEY, *_whole_span()))
        # A key needs an automaton if it has several forms, at least one of them found once; a single window is settled by its hash.
        keys = counted.groupBy("key").agg(F.count(F.lit(1)).alias("forms"), F.min("n").alias("least")).filter((F.col("forms") > 1) & (F.col("least") == 1))
        rest = cut.filter(F.col("low") < F.col("high")).join(counted, ["key", "whole"]).filter(F.struct(*_KEY, "start") == F.col("one")).join(keys.select("key", "forms"), "key")
        rest = stored(rest.select("key", *_KEY, "start", "windows", "left", "low", "high", (F.col("n") == 1).alias("single"), "words", (F.col("forms") > forms).alias("crowded")))
        shards = rest.filter(~F.col("crowded")).select("key", *_KEY, "start", "words", "single").repartition("key").sortWithinPartitions("key")
        spans.append(shards.mapInArrow(_match(window), "doc long, sig long, first long, last long"))
        pieces = rest.filter("crowded").drop("crowded")
    return spans


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_LEAST)).alias("doc"), F.xxhash64(docs[text_col]).alias("sig"), docs[text_col].alias("text"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, forms: int = FORMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, sig, first, last): spans of consecutive repeated windows, by first word; sig tells apart rows of one id."""
    keyed = _keyed(docs, id_col, text_col)
    found = stored(keyed.mapInArrow(_anchors(window), "anchor long, whole long, doc long, sig long, start int, windows int, left int"))
    # Stored first, so that both sides of the join are plain exchanges, whose crowded partitions Spark can split.
    again = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("anchor"))
    filed = stored(found.join(again, "anchor", "left_semi"))
    counted = stored(filed.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_KEY, "start", "windows", "left")).alias("one")))
    copies = filed.join(counted.filter(F.col("n") > 1).select("anchor", "whole"), ["anchor", "whole"], "left_semi")
    copies = copies.select(*_KEY, *_whole_span())
    varied = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("forms"), F.min("n").alias("least")).filter((F.col("forms") > 1) & (F.col("least") == 1))
    refs = counted.join(varied.select("anchor", (F.col("forms") > forms).alias("crowded")), "anchor")
    refs = refs.select("one.doc", "one.sig", F.struct("anchor", "one.start", "one.windows", "one.left", (F.col("n") == 1).alias("single"), "crowded").alias("ref"))
    refs = refs.groupBy(*_KEY).agg(F.collect_list("ref").alias("refs"))
    # Repeated rows give the same snippets, so one of them is enough here.
    wanted = keyed.join(refs.select(*_KEY), _KEY, "left_semi").groupBy(*_KEY).agg(F.first("text").alias("text"))
    snips = stored(wanted.join(refs, _KEY).select(*_KEY, "text", "refs").mapInArrow(
        _snippet_texts(window), "anchor long, doc long, sig long, start int, windows int, left int, single boolean, crowded boolean, words binary"))
    shards = snips.filter(~F.col("crowded")).select("anchor", *_KEY, "start", "words", "single").repartition("anchor").sortWithinPartitions("anchor")
    matched = shards.mapInArrow(_match(window), "doc long, sig long, first long, last long")
    pieces = snips.filter("crowded").select(F.col("anchor").alias("key"), *_KEY, "start", "windows", "left", F.lit(0).alias("low"), F.lit(window - GRAM).alias("high"), "single", "words")
    out = copies.unionByName(matched)
    for spans in crowded_spans(pieces, window, forms):
        out = out.unionByName(spans)
    return out


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words_, gone, kept = [], [], []
            for text, spans in zip(b.column(0), b.column(1)):
                words = raw(text.as_py()).split()
                words_.append(len(words))
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    s = spans.values
                    np.add.at(edge, s.field("first").to_numpy(), 1)
                    np.add.at(edge, s.field("last").to_numpy() + window, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, stays.tolist()) if k]
                gone.append(words_[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([pa.array(words_, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                                   *b.columns[2:]], names=["n_words", "n_removed", "kept_text", *b.schema.names[2:]])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, forms: int = FORMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row: the words that stay, joined by one space."""
    spans = repeated_spans(docs, window, forms, id_col, text_col).groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    keyed = _keyed(docs, id_col, text_col).withColumn("doc_id", F.nullif("doc", F.lit(_LEAST)))
    joined = keyed.join(spans.hint("shuffle_hash"), _KEY, "left").select("text", "spans", "doc_id")
    return joined.mapInArrow(_remove(window), "n_words long, n_removed long, kept_text string, doc_id long").select("doc_id", "n_words", "n_removed", "kept_text")
