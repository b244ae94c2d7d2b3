"""Prediction by partial matching against a plain model."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from embedmap.llm import ppm, queries, registry
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def out_of_training(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def tokens(text):
    return [w.encode() for w in plain.words(plain.lowered(text or ""))]


class PlainModel:
    """Trie as nested counts; a symbol is counted at a shorter context only where it was new at the longer one."""

    def __init__(self, texts, order):
        self.order = order
        self.trie = defaultdict(Counter)
        for t in texts:
            data = b"\n" * order + t
            for i in range(order, len(data)):
                for k in range(order, -1, -1):
                    c = self.trie[data[i - k:i]]
                    c[data[i]] += 1
                    if c[data[i]] > 1:
                        break

    def log10(self, text):
        data, total = b"\n" * self.order + text, 0.0
        for i in range(self.order, len(data)):
            total += math.log10(self.symbol(data[i - self.order:i], data[i]))
        return total

    def symbol(self, context, s):
        p, offered = 1.0, set()
        for k in range(self.order, -1, -1):
            c = self.trie.get(context[self.order - k:], {})
            left = {x: n for x, n in c.items() if x not in offered}
            total = sum(left.values())
            if s in left:
                return p * (left[s] - 0.5) / total
            if left:
                p *= 0.5 * len(left) / total
            offered |= set(left)
        return p / (256 - len(offered))


def expected(rows, held, order):
    body = lambda t: b" ".join(tokens(t)) + b"\n"
    counts = Counter(w for d, t, _ in rows if not held(d) for w in [*tokens(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    model = PlainModel([body(t) for d, t, _ in rows if not held(d)], order)
    for d, t, _ in rows:
        some = [*tokens(t), b"\n"]
        yield d, held(d), len(some), sum(w in counts for w in some), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in some), model.log10(body(t))


def close(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[2], r[-1])) for x in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g[:5]) == tuple(w[:5])
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order,chunk,stretch,block", [(5, ppm.CHUNK_BYTES, ppm.STRETCH_BYTES, ppm.BLOCK_PAIRS), (3, 500, 100, 10), (7, 3000, 1000, 50)])
def test_against_plain_version(spark, monkeypatch, order, chunk, stretch, block):
    monkeypatch.setattr(ppm, "STRETCH_BYTES", stretch)
    monkeypatch.setattr(ppm, "BLOCK_PAIRS", block)
    rows = [(d, t if not t or len(t) < 20_000 else t[:20_000], s) for d, t, s in plain.messy(spark)[0]]
    df = plain.documents(spark, rows).repartition(3, F.col("doc_id"))
    out = ppm.ppm_scores(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, order=order, chunk_bytes=chunk)
    assert out.columns == [*[c for c in df.columns if c != "text"], "_lm"]
    assert [out.filter("doc_id = 1").first()[c] for c in ("key", "class")] == ["x", "x"]
    got = out.select("doc_id", "_lm.held_out", "_lm.n_tokens", "_lm.n_known", "_lm.train_tokens", "_lm.base_score", "_lm.score").collect()
    assert any(r.held_out for r in got)
    close([tuple(r) for r in got], list(expected(rows, out_of_training, order)))


def test_probabilities_add_up():
    """What may follow a context adds up to 1, also where the context is unknown."""
    import numpy as np

    codes, _ = ppm.pair_codes([b"the cat sat on the mat\n", b"a cat\n"], 3)
    pairs, n = np.unique(codes, return_counts=True)
    levels = {3: (pairs, n)}
    for k in (2, 1, 0):
        levels[k] = ppm.level_up(levels[k + 1][0], k)
    for context in (b"the", b" ca", b"xca", b"xyt", b"xyz"):
        wanted = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** ppm.score_pairs(wanted, levels, 3)).sum() == pytest.approx(1)


def test_no_training_rows_and_names(spark):
    names = ("row", "learned", "chunk", "kind", "body", "code", "n", "word", "value", "kept", "out", "a.b")
    df = spark.createDataFrame([(1, "Ab", *names), (2, None, *names)], ["doc_id", "text", *names])
    got = {r.doc_id: r for r in ppm.ppm_scores(df, F.lit(True)).collect()}
    assert all(tuple(r[n] for n in names) == names for r in got.values())
    assert got[1]._lm.score == pytest.approx(-3 * math.log10(256)) and got[1]._lm.base_score == 0 and got[1]._lm.train_tokens == 0
    assert got[2]._lm.score == pytest.approx(-math.log10(256)) and got[2]._lm.n_tokens == 1 and got[2]._lm.n_known == 0
    assert ppm.ppm_scores(df.withColumn("_lm", F.lit(1)), F.lit(True)).columns == ["doc_id", *names, "_lm"]


def test_held_out_texts_are_predicted_better_than_by_the_base(spark):
    out = registry.QUERIES["op11_ppm_scores"](spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert out.model > out.base


def test_empty_table(spark, scratch):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{scratch}/documents.parquet")
    assert queries.op11 and registry.QUERIES["op11_ppm_scores"](spark, scratch).count() == 0
