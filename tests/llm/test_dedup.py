"""Line dedup, near-duplicate classes and repeated passages against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.llm import lines, neardup, queries, registry, substrings, words
from embedmap.llm.components import components
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def tuples(df):
    return plain.order(tuple(r) for r in df.collect())


def line_rows(df, **limits):
    return tuples(lines.dedup_lines(df, **limits).select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.text", 256)))


@pytest.mark.parametrize("crowded", [lines.CROWDED, 1])
def test_lines(spark, crowded, monkeypatch):
    monkeypatch.setattr(lines, "TIMES_MEAN", 0)
    rows, df = plain.messy(spark)
    assert line_rows(df, crowded=crowded) == plain.order(plain.line_dedup(rows))


def test_line_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain.line_dedup([(r.doc_id, r.text, "") for r in docs])
    assert tuples(registry.QUERIES["op2_line_dedup"](spark, SF)) == plain.order(want)


def test_line_dedup_has_no_python_and_one_pass_over_the_text(spark):
    df = plain.messy(spark)[1]
    plan = lines.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan


def near_rows(df, width, percent):
    return [tuple(r) for r in neardup.near_duplicates(df, width, percent).select("doc_id", "n_shingles", "component_id").collect()]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rows, df = plain.messy(spark)
    assert plain.order(near_rows(df, width, percent)) == plain.order(plain.near_classes(rows, width, percent))


def test_near_query_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = registry.QUERIES["op5_minhash_near_dedup"](spark, "/root/testdata/sf0.01")
    want = plain.near_classes([(r.doc_id, r.text, "") for r in docs], 3, 85)
    assert tuples(got.select("doc_id", "n_shingles", "component_id")) == plain.order(want)
    assert got.filter(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).isEmpty()


def test_family_whose_middle_is_not_the_smallest(spark, monkeypatch):
    """Copies that are close to one original only, which has the largest id: found by the meeting of blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = plain.prose(9, 200)
    rows = []
    for i in range(40):
        changed = list(base)
        for k in range(3):
            changed[(i * 5 + k * 61) % 200] = f"edit{i}x{k}"
        rows.append((i, " ".join(changed), "s"))
    rows.append((99, " ".join(base), "s"))
    df = plain.documents(spark, rows)
    assert plain.order(near_rows(df, 3, 90)) == plain.order(plain.near_classes(rows, 3, 90))


def test_odd_sketch_estimates_high_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64))
    b = np.concatenate([a[:-100], np.random.default_rng(2).integers(0, 1 << 63, 100).astype(np.uint64)])
    samples = neardup._min_hashes([a, b])
    sketch = neardup.odd_sketches(samples)
    z = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
    differing = np.log(1 - 2 * z / neardup.SKETCH_BITS) / np.log(1 - 2 / neardup.SKETCH_BITS)
    assert abs(1 - differing / (2 * neardup.SAMPLES) - (samples[:, 0] == samples[:, 1]).mean()) < 0.03
    assert z <= neardup.most_bits(0.85)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 101)], "a long, b long")
    got = dict(tuple(r) for r in components(links).collect())
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100}


def repeat_rows(df, **limits):
    return tuples(substrings.remove_repeats(df, **limits).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)))


@pytest.mark.parametrize("forms,window", [(500, 35), (1, 35), (2, 20), (1, 8)])
def test_repeats(spark, forms, window):
    rows, df = plain.messy(spark)
    assert repeat_rows(df, window=window, forms=forms) == plain.order(plain.remove_repeats(rows, window))


def test_a_passage_in_many_surroundings(spark):
    """Crowded anchors are halved until their shards are small; a snippet makes at most two pieces a round."""
    passage = plain.prose(77, 60)
    rows = [(i, " ".join(plain.prose(1000 + i, i % 40) + passage[i % 3:60 - i % 4] + plain.prose(5000 + i, 30 - i % 17)), "s") for i in range(120)]
    df = plain.documents(spark, rows)
    assert repeat_rows(df, forms=3) == repeat_rows(df) == plain.order(plain.remove_repeats(rows))
    made = []
    real = substrings.stored
    substrings.stored = lambda d, *a: made.append((d.columns, (out := real(d, *a)).count())) or out
    try:
        repeat_rows(df, forms=3)
    finally:
        substrings.stored = real
    crowded = [n for c, n in made if "key" in c and "whole" in c and "words" in c]
    assert crowded and max(crowded) <= 2 * max(n for c, n in made if c[:1] == ["anchor"])


def test_repeats_over_short_stretches(spark, monkeypatch):
    rows = [(i, " ".join(plain.prose(i % 3, 150)[i:]), "s") for i in range(9)]
    whole = substrings.snippets
    h, bounds = words.word_hashes(words.texts(__import__("pyarrow").array([t for _, t, _ in rows])))
    parts = {}
    for stretch in (1 << 22, 40):
        monkeypatch.setattr(substrings, "STRETCH", stretch)
        doc, start, n, anchor, *_ = whole(h, bounds, 35)
        parts[stretch] = sorted((d, s + k, a) for d, s, m, a in zip(doc.tolist(), start.tolist(), n.tolist(), anchor.tolist()) for k in range(m))
    assert parts[40] == parts[1 << 22] and len(parts[40]) == sum(len(t.split()) - 34 for _, t, _ in rows)


def test_repeat_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain.remove_repeats([(r.doc_id, r.text, "") for r in docs])
    assert tuples(registry.QUERIES["op7_substring_dedup"](spark, SF)) == plain.order(want)


def test_automaton_matches():
    a = substrings.SuffixAutomaton([list("abcdefgh"), list("xcdefy"), list("cdzz")])
    assert list(a.matches(list("abcdefgh"), 3)) == [(2, 3)]
    assert list(a.matches(list("qqcdefqcd"), 4)) == [(2, 2)]


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_minhash_near_dedup", "op7_substring_dedup"])
def test_empty_table(spark, scratch, name):
    plain.documents(spark, []).write.parquet(f"{scratch}/documents.parquet")
    assert registry.QUERIES[name](spark, scratch).count() == 0
    assert queries.tokenizer_path()
