"""Inputs whose columns have the names of every helper: values pass through unchanged and results stay the same."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from embedmap.llm import hostrules, infill, lines, mixing, ppm, queries, urltree, weaklabels
from tests.llm import plain

FOLDER = Path(lines.__file__).parent


def names_in(*modules):
    """Every quoted word of the modules that could be a column, but for the columns that the operators read."""
    found = {n for m in modules for n in re.findall(r'"(_?[a-z][a-z0-9_]*)"', Path(m.__file__).read_text())}
    return sorted(found - {"doc_id", "text", "source", "page_id", "url", "id", "n_chars"})


def named(df, names):
    return df.select(*df.columns, *[F.lit(f"value of {n}").alias(n) for n in names if n not in df.columns])


def untouched(out, names):
    row = out.first()
    assert all(row[n] == f"value of {n}" for n in names)


def docs(spark):
    rows = [(i, f"{' '.join(plain.prose(i % 7, 30))}\nA line that three documents share or more\nend {i}", f"s{i % 2}", i) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


@pytest.mark.parametrize("module,run,result", [
    (lines, lines.dedup_lines, "_lines"), (hostrules, hostrules.judge, "_quality"), (mixing, mixing.mix, "_mix"),
    (ppm, lambda d: ppm.ppm_scores(d, F.col("doc_id") == 3), "_lm"), (infill, lambda d: infill.rebuilt(infill.fill_in_middle(infill.framed(d))), "_restored")])
def test_documents(spark, module, run, result):
    plain_docs = docs(spark)
    made = {"_frames", "_infill", "_restored", "_lm", "_mix", "_quality", "_lines"}
    names = [n for n in names_in(module) if n not in made]
    assert len(names) > 10
    out = run(named(plain_docs, names))
    untouched(out, names)
    want, got = (plain.order(map(str, d.select("doc_id", f"{result}.*").collect())) for d in (run(plain_docs), out))
    assert got == want
    assert run(named(plain_docs, [result])).select(f"{result}.*").count() == out.count()


def test_weak_labels_and_urls(spark):
    names = [n for n in names_in(weaklabels) if n != "_weak"]
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    out = weaklabels.weak_scores(named(docs(spark), names), labels)
    untouched(out, names)
    pages = spark.createDataFrame([(i, f"http://h.org/a{i % 3}/{i}") for i in range(20)], "page_id long, url string")
    names = [n for n in names_in(urltree) if n not in ("host", "path", "rule", "verdict", "template")]
    unwanted = spark.createDataFrame([(1, 1), (2, 0)], "id long, unwanted int")
    out = urltree.judge_urls(named(pages, names), unwanted, queries.URL_RULES)
    untouched(out, names)
    assert out.count() == 20


def test_pipeline_stages(spark):
    names = sorted({*names_in(lines, hostrules, mixing), "_goes", "_quality", "_lines", "_mix", "_split", "a.b", "a`b"} - {"n_chars"})
    start = named(docs(spark), names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        start = stage(spark, start, "")
        assert [c for c in start.columns] == [*docs(spark).columns, *names], name
    untouched(start, names)
    assert start.count() > 0 and corpus_pipeline.pack(spark, start, "").count() >= start.count()
