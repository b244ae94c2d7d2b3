"""Mixing, packing, exact search and the pipeline."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from embedmap.llm import mixing, packing, queries, registry, topk
from tests.llm import plain


def plain_mix_rows(rows, out):
    """Checks that hold for any mix: whole passes, budgets and blocks."""
    total = defaultdict(int)
    for _, t, s in rows:
        total[s or ""] += len(plain.words(t)) + 1
    taken, epochs = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in out:
        s = r.source or ""
        assert r.source_tokens == total[s]
        taken[s] += r.tokens
        epochs[s][r.epoch] += r.tokens
    for s, of in total.items():
        budget = next(r.source_budget for r in out if (r.source or "") == s)
        assert taken[s] <= budget
        for e in range(budget // of):
            assert epochs[s][e] == of
    return total


def mixed(df, **kw):
    return mixing.mix(df, **kw).select("doc_id", "source", "_mix.*").collect()


def test_covering_mix(spark):
    rows, df = plain.messy(spark)
    out = mixed(df, max_repeat=1e9, block_tokens=500, bucket_tokens=64)
    total = plain_mix_rows(rows, out)
    budgets = {r.source or "": r.source_budget for r in out}
    w = np.array([budgets[s] for s in total], float)
    w /= w.sum()
    assert -(w * np.log(w)).sum() >= 0.97 * math.log(len(total))
    blocks = 1 + max(r.block for r in out)
    for s in ("s1", "s2"):  # every block holds the source in its weight
        assert len({r.block for r in out if r.source == s}) > blocks // 4


def test_repetition_limit_and_budget(spark):
    rows, df = plain.messy(spark)
    out = mixed(df, max_repeat=4.0)
    plain_mix_rows(rows, out)
    assert max(r.source_budget / r.source_tokens for r in out) <= 4.001
    few = mixed(df, budget=5000, entropy=0.0, max_repeat=1.0)
    assert sum(r.tokens for r in few) <= 5000 and all(r.epoch == 0 for r in few)


def test_mix_of_nothing_and_of_one_source(spark):
    assert mixed(plain.documents(spark, [])) == []
    assert len(mixed(plain.documents(spark, [(1, "a b", None), (2, None, None)]))) == 2


TEXTS = ["it's <|endoftext|> don't", "É́ ﬁ İstanbul ΣΑΣ\x1cabc_d 1²3", "naïve co-op—x'll", "ǅ <|startoftext|>x", "a b ª º µ", "", " \n a  b\x85c\xa0d ", "ab12cd!? ... 99a", "Straße | Über,été"]


def test_word_encoder_equals_the_tokenizer():
    import pyarrow as pa

    e = packing.WordEncoder(queries.tokenizer_path(), cache_pieces=8)
    assert [x.tolist() for x in e.encode(pa.array(TEXTS, pa.large_string()))] == [e.plain(t) for t in TEXTS]
    long = " ".join(plain.prose(4, 3000))
    assert np.concatenate([x for p in packing.parts(long, 1000) for x in e.encode(pa.array([p], pa.large_string()))]).tolist() == e.plain(long)


def test_pieces_hold_every_id_once(spark):
    rows, df = plain.messy(spark)
    rows += [(30 + i, t, "s") for i, t in enumerate(TEXTS)]
    e = packing.WordEncoder(queries.tokenizer_path())
    ids = defaultdict(list)
    for d, t, _ in rows:
        ids[d].append([*e.plain(t or ""), 2])
    out = packing.pack(plain.documents(spark, rows), queries.tokenizer_path()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        whole = ids[r.doc_id][0]
        assert r.doc_tokens == len(whole) and zlib.crc32(np.array(whole[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for d, copies in ids.items():
        assert sorted(i for r in by_doc[d] for i in range(r.start, r.start + r.length)) == sorted(list(range(len(copies[0]))) * len(copies))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 4096, 800)
    slot = packing.near_equal(sizes, 4096)
    full = np.bincount(slot, sizes)
    assert full.max() <= 4096 and full.sum() / (len(full) * 4096) > 0.97
    two = np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(two.tolist()) == [14, 16]


def test_padding_on_the_table(spark):
    out = registry.QUERIES["op8_packing"](spark, "/root/testdata/sf0.01")
    ids, sequences = out.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert ids / (4096 * sequences) > 0.97


def plain_top(rows, k, every):
    """Every usable row is a candidate; a query id has the best of all its rows."""
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    found = {}
    for i, v in q:
        if i % every == 0:
            found.setdefault(i, []).extend((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i and len(w) == len(v))
    return [(i, n + 1, j, -s) for i, some in found.items() for n, (s, j) in enumerate(sorted(some)[:k])]


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(60)]
    rows += [(60 + i, rows[i % 5][1]) for i in range(20)]  # ties
    rows += [(200, None), (201, []), (202, [None] * 8), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (None, rows[0][1]), (3, rows[3][1]), (3, [0.0] * 8),
             (10, [9.0] * 8), (10, rows[10][1]), (41, [8.0] * 8), (41, [-8.0] * 8),
             (205, [1.0, 2.0]), (210, [0.5, 0.5]), (220, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, dim int, block int")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, block_rows=block, query_values=24)
    assert plain.order(tuple(r) for r in got.collect()) == plain.order(plain_top(rows, 5, 10))


def test_reading_stops_early():
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(10, 32)) * 40
    x = np.floor(centre[rng.integers(0, 10, 2000)] + rng.normal(size=(2000, 32)) * 8)
    lists, resolved = topk.Lists(np.arange(2000), x), []
    plain_resolve = lists._resolve
    lists._resolve = lambda rows, *a: (resolved.append(len(rows)), plain_resolve(rows, *a))[1]
    for i in range(20):
        rows, scores = lists.best(x[i], i, 5, -np.inf)
        s = x @ x[i]
        s[i] = -np.inf
        assert scores.tolist() == sorted(s, reverse=True)[:5]
    assert np.median(resolved) < 700


def test_empty_tables(spark, scratch):
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(0).write.parquet(f"{scratch}/embeddings.parquet")
    plain.documents(spark, []).write.parquet(f"{scratch}/documents.parquet")
    for name in ("op10_exact_topk", "op8_packing", "op6_temperature_mix", "pipeline"):
        assert registry.QUERIES[name](spark, scratch).count() == 0


def test_pipeline_against_a_plain_version(spark):
    """Stage by stage over messy rows: what goes, what the texts become, and that packing holds all of it."""
    rows, df = plain.messy(spark)
    rows += [(40, " ".join(plain.prose(8, 50)), "s4"), (41, " ".join(plain.prose(8, 50)), "s4")]
    df = plain.documents(spark, rows)
    now, kept = df, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in now.collect()}
        out = stage(spark, now, "")
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
        got = [(r.doc_id, r.text, r.source) for r in out.collect()]
        was = [(r.doc_id, r.text, r.source) for r in now.collect()]
        if name == "quality_rules":
            assert {r[0] for r in got} <= {d for d, t, _ in was if not plain.quality(t)[-1]} and (1, rows[0][1], "s0") in got
        if name == "line_dedup":
            assert plain.order((d, plain.sha(t or "")) for d, t, _ in got) == plain.order((d, h) for d, _, _, h in plain.line_dedup(was))
        if name == "near_dedup":
            classes = plain.near_classes(was, 5, 80)
            assert plain.order(got) == plain.order(r for r, c in zip(was, classes) if c[0] is None or c[0] == c[2])
        if name == "mix_sources":
            assert set(got) == set(was) and len(got) <= 4 * len(was)
        now, kept = out, got
        assert before
    ids = corpus_pipeline.STAGES[-1][1](spark, now, "").agg(F.sum("length")).first()[0]
    e = packing.WordEncoder(queries.tokenizer_path())
    assert ids == sum(len(e.plain(t or "")) + 1 for _, t, _ in kept)


def test_slices_and_cache_of_packing_change_no_row(spark):
    docs = plain.documents(spark, [(i, f"word{i} some words\nof text {i * 7} " * (i % 5 + 1), "s") for i in range(60)]).coalesce(2)
    path = queries.tokenizer_path()
    want = sorted(map(tuple, packing.pack(docs, path).collect()))
    assert sorted(map(tuple, packing.pack(docs, path, slice_chars=50, cache_pieces=8).collect())) == want
