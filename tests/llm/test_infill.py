"""Fill-in-middle over compressed frames."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from embedmap.llm import infill, queries, registry
from tests.llm import plain

SF = "/root/testdata/sf0.001"
FIELDS = ("n_units", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def expected(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, z = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:z]), "".join(u[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc, len(u), "plain", None, None, plain.sha(text), plain.sha(text)), text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return (doc, len(u), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), plain.sha(out), plain.sha(text)), out


def odd_rows():
    texts = ["a" * 500, "é" * 300, "abc<P>def", "x<S", "a\U0001f600b\n" * 40, "<M>", " ", "1a2b", "ab" * 70 + "ü" + "Z" * 90, None, "", "\r\n\t", "Aé<P" * 30]
    return [(100 + 50 * k + i, t, "s") for k in range(6) for i, t in enumerate(texts)] + [(None, "no id here", "s"), (7, "same", "s"), (7, "same", "s")]


@pytest.mark.parametrize("size", [8, 17, 64, infill.FRAME_BYTES])
def test_against_plain_version(spark, size):
    rows = plain.messy(spark)[0] + odd_rows()
    df = plain.documents(spark, rows)
    stored = infill.framed(df, frame_bytes=size)
    assert stored.columns == [*[c for c in df.columns if c != "text"], "_frames"]
    done = infill.fill_in_middle(stored, frame_bytes=size)
    got = infill.rebuilt(done).select("doc_id", *[f"_restored.{c}" for c in FIELDS]).collect()
    assert plain.order(map(tuple, got)) == plain.order(expected(d, t)[0] for d, t, _ in rows)
    texts = infill.unframed(done, "_infill.output", "output").select("doc_id", "output").collect()
    assert plain.order(map(tuple, texts)) == plain.order((d, expected(d, t)[1]) for d, t, _ in rows)


def test_cut_frames_alone_are_read(spark):
    """A cut decompresses its own frame (and at most the one before), not the text."""
    writer = infill.FrameWriter(64)
    for piece in infill.pieces(b"word 12 " * 1000, 64):
        writer.write(piece)
    reader = infill.FrameReader([dict(zip(("units_before", "chars_before", "bytes_before", "data"), f)) for f in writer.close()])
    read = []
    whole, reader.frame = reader.frame, lambda i: read.append(i) or whole(i)
    assert reader.place(3000) == (600 * 8, 600 * 8) and len(read) <= 2


def test_names_and_empty_table(spark, scratch):
    """Columns that look like the helpers pass through; one named as the result gives way."""
    names = ("row", "made", "v0", "v1", "value", "name", "frames", "n_units", "a.b", "a`b", "none")
    df = spark.createDataFrame([(1, "some text", *names)], ["doc_id", "text", *names])
    out = infill.rebuilt(infill.fill_in_middle(infill.framed(df)))
    assert tuple(out.first()[n] for n in names) == names
    assert infill.framed(df.withColumn("_frames", F.lit(1))).columns == ["doc_id", *names, "_frames"]
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{scratch}/documents.parquet")
    assert "op13_infill" in registry.CHECKS and queries.INFILL_SQL and registry.QUERIES["op13_infill"](spark, scratch).count() == 0
