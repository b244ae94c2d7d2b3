"""Host rules, URL templates, weak labels and WARC derivatives."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedmap.llm import hostrules, queries, registry, urltree, warc, weaklabels
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_counts_and_base_rule(spark):
    rows, df = plain.messy(spark)
    out = hostrules.judge(df)
    assert out.columns == [*df.columns, "_quality"]
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = [tuple(r) for r in out.select("doc_id", *[f"_quality.{c}" for c in fields]).collect()]
    assert plain.order(got) == plain.order((d, *plain.quality(t)) for d, t, _ in rows)


def test_host_habit_decides(spark):
    """A rule that a host fails again and again drops its failing documents, one accident at a clean host doesn't."""
    junk, clean = "bad### word$$$ " * 15, " ".join(plain.prose(1, 40))
    rows = [(i, junk if i % 2 else clean.replace("a", str(i)), "bad") for i in range(40)]
    rows += [(100 + i, f"{clean} {i}", "good") for i in range(2000)] + [(5000, junk.replace("bad", "odd"), "good")]
    rows = [(d, t if "###" not in t else " ".join(f"w{d}{k}### x{k}$$$" for k in range(15)), s) for d, t, s in rows]
    kept = {r.doc_id: r.kept for r in hostrules.judge(plain.documents(spark, rows)).select("doc_id", "_quality.kept").collect()}
    assert not any(kept[i] for i in range(1, 40, 2)) and all(kept[i] for i in range(0, 40, 2)) and kept[5000]


@pytest.mark.parametrize("name,table", [("op4_host_rules", "documents"), ("op9_weak_labels", "documents"), ("op1_warc_derivatives", "pages"), ("op3_url_templates", "pages")])
def test_empty_tables(spark, scratch, name, table):
    for t in ("documents", "pages", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{scratch}/{t}.parquet")
    assert registry.QUERIES[name](spark, scratch).count() == 0


URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.NET/en/1?x#y", "http://example.net/de/", "http://a.example.com/de/5", "http://b.org/fr/", "http://b.org",
        "http://example.net", "x://y://z.net/a", "http://ÄB.org/é/1#x?y", "http://notexample.com/de/"]


def plain_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (plain.lowered(m[1]), m[2]) if m else ("", "")
    best = None
    for said, text in queries.URL_RULES:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = (said, text)
    return host, path, best


def test_rules_of_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[4]), (4, URLS[4])]
    pages = spark.createDataFrame([(*r, "t", "v", "r") for r in rows], "page_id long, url string, template string, rejected string, id string")
    labels = spark.createDataFrame([(0, 1), (None, 1), (5, None), (4, 1)], "id long, unwanted int")
    got = urltree.judge_urls(pages, labels, queries.URL_RULES)
    assert {"rejected", "id", "template"} <= set(got.columns)
    seen = plain.order((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect())
    want = []
    for i, u in rows:
        host, path, best = plain_url(u)
        want.append((i, host, path, best[1] if best else None, best[0] if best else "allow"))
    assert seen == plain.order(want)


def test_templates_split_by_purity(spark):
    rows = [(i, f"http://h.test/{'spam' if i % 2 else 'news'}/item-{i}/{i}.html") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 3)], "id long, unwanted int")
    got = {r.page_id: r for r in urltree.judge_urls(pages, labels).collect()}
    assert got[1].template == "/spam/*/*.html" and got[0].template == "/news/*/*.html"
    assert all((r.verdict == "block") == bool(i % 2) for i, r in got.items())
    alike = urltree.judge_urls(pages, labels.withColumn("unwanted", F.lit(0))).first()
    assert alike.template == "/{news|spam}/*/*.html"


def test_weak_labels_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.filter(F.col("doc_id") % 3 != 0)
    got = weaklabels.weak_scores(docs, known).join(labels.filter(F.col("doc_id") % 3 == 0), "doc_id").select("doc_id", "_weak.*", "quality", "toxic").collect()
    junk = [(r.junk_score > 0.5, r.quality == 0) for r in got]
    clean = [r.kept for r in got if r.quality == 1 and not r.toxic]
    assert sum(a == b for a, b in junk) / len(junk) > 0.93
    assert sum(clean) / len(clean) > 0.93


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(20_000) < 0.2, 2, np.where(rng.random(20_000) < a, truth, ~truth)) for a in (0.95, 0.85, 0.75)], 1).astype(np.int64)
    patterns, counts = np.unique(votes @ np.array([9, 3, 1]), return_counts=True)
    rates, posterior, share = weaklabels.fit_votes(patterns, np.full(len(patterns), -1), counts.astype(float), 3)
    assert abs(share - 0.3) < 0.05
    assert [round(rates[1, j, 1] / (rates[1, j, 0] + rates[1, j, 1]), 1) for j in range(3)] == pytest.approx([0.95, 0.85, 0.75], abs=0.06)


def test_weak_labels_take_messy_rows(spark):
    rows, df = plain.messy(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    assert weaklabels.weak_scores(df, labels).count() == len(rows)


def test_derivatives_link_back_and_round_trip(spark, scratch):
    html = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>One<br>two &lt;3</p><script>var t='</p>';</script><!-- x --><div>End</div>"
    pages = spark.createDataFrame([(1, "http://x.test/", html), (2, None, None), (None, "http://y.test/", "plain\r\n\r\ntext"), (1, "http://x.test/", html)],
                                  "page_id long, url string, html string")
    source = warc.responses(pages)
    made = warc.derive(source)
    got = {(r.page_id, r.type): r for r in made.collect()}
    assert made.count() == 8 and got[1, "conversion"].block == "A & B\nOne\ntwo <3\nEnd"
    for r in got.values():
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
    meta, origin = got[1, "metadata"], source.filter("page_id = 1").first()
    assert meta.refers_to == origin.record_id and f"source-block-digest: {origin.block_digest}" in meta.block and "source-header-Content-Type: text/html" in meta.block
    assert len({r.record_id for r in got.values()}) == 6
    warc.write_warc(made, f"{scratch}/w")
    back = warc.read_warc(spark, f"{scratch}/w").select("intact", F.element_at("headers", "warc-record-id").alias("id"),
                                                       F.element_at("headers", "warc-refers-to").alias("to"), F.col("block").cast("string").alias("block"))
    want = plain.order((True, r.record_id, r.refers_to, r.block) for r in made.collect())
    assert plain.order(tuple(r) for r in back.collect()) == want


def test_responses_from_a_warc_file(spark, scratch):
    import os

    os.makedirs(f"{scratch}/in")
    body = "HTTP/1.1 404 Gone\r\nContent-Type: text/html\r\nX-A: b:c\r\n\r\n<p>né</p>\r\n\r\nmore"
    record = lambda kind, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\nWARC-Target-URI: http://z.test/\r\nContent-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n"
    with open(f"{scratch}/in/a.warc", "wb") as f:
        f.write((record("warcinfo", "software: x") + record("response", body)).encode())
    source = warc.source_responses(warc.read_warc(spark, f"{scratch}/in"))
    made = {r.type: r for r in warc.derive(source).collect()}
    assert source.count() == 1 and made["conversion"].block == "né\nmore" and made["conversion"].refers_to == "<urn:uuid:response>"
    assert "source-status: 404\r\nsource-header-Content-Type: text/html\r\nsource-header-X-A: b:c\r\n" in made["metadata"].block


def test_a_record_inside_a_body(spark, scratch):
    """Bodies that hold record starts come back whole; a truncated record neither swallows its followers nor vanishes silently."""
    import os

    os.makedirs(f"{scratch}/in")
    record = lambda name, block, size=None: (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n"  # noqa: E731
                                             f"Content-Length: {len(block.encode()) if size is None else size}\r\n\r\n{block}\r\n\r\n")
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    inner = http + "before" + "\r\n\r\n" + record("inner", http + "é") + "middle\r\n\r\nWARC/1.9 nonsense\r\n\r\nafter"
    blocks = {"a": http + "plain", "b": inner, "c": http + "last"}
    for name, order in (("x", "abc"), ("y", "cba")):
        with open(f"{scratch}/in/{name}.warc", "wb") as f:
            f.write("".join(record(name + k, blocks[k]) for k in order).encode())
    got = warc.read_warc(spark, f"{scratch}/in").select(F.element_at("headers", "warc-record-id").alias("id"), F.col("block").cast("string"), "intact").collect()
    assert plain.order(map(tuple, got)) == plain.order((f"<urn:uuid:{n}{k}>", b, True) for n in "xy" for k, b in blocks.items())
    assert warc.source_responses(warc.read_warc(spark, f"{scratch}/in")).count() == 6
    os.makedirs(f"{scratch}/cut")
    with open(f"{scratch}/cut/z.warc", "wb") as f:
        f.write((record("short", http + "cut off", 5000) + record("d", inner) + record("e", http + "end")).encode())
    records = warc.read_warc(spark, f"{scratch}/cut")
    assert plain.order((r.id, r.intact) for r in records.select(F.element_at("headers", "warc-record-id").alias("id"), "intact").collect()) == [
        ("<urn:uuid:d>", True), ("<urn:uuid:e>", True), ("<urn:uuid:short>", False)]
    with pytest.raises(Exception, match="damaged record <urn:uuid:short>"):
        warc.source_responses(records)
    assert warc.source_responses(records, damaged="skip").count() == 2
