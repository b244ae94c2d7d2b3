"""WARC derivatives: every response record becomes a metadata record and a plain-text conversion record.

Both are linked to their source: WARC-Refers-To holds its record id, WARC-Refers-To-Target-URI and -Date its address and date, and the
source's HTTP headers and digests are kept as fields of the metadata block; the conversion keeps the payload digest of the
page it was made from. Record ids are UUIDs from md5(kind, source id), so a lost task writes the same records again.
Digests are ``sha256:`` and hex. Everything is one narrow projection; records are written with Spark's text
writer, whose line separator is the end of a WARC record, and read by splitting at record starts.

Defined cases: a null url is an empty address, a null page an empty body (empty conversion); a null id counts as the text
'null' in record ids; repeated rows give records with equal ids; an empty table gives no records; a body of any length is one record; other
columns are dropped by name only where the result defines them. Scripts, styles, comments and tags go, blocks end lines, the entities
lt, gt, quot, apos (39), nbsp and amp are decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
_HIDDEN = r"(?is)<script[^>]*>.*?(</script[ \t\r\n]*>|\z)|<style[^>]*>.*?(</style[ \t\r\n]*>|\z)|<!--.*?(-->|\z)"
_BLOCKS = r"(?i)</?(p|div|br|hr|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|main|form|pre|blockquote)(/?>|[ \t\r\n][^>]*>)"


def plain_text(html: Column) -> Column:
    """Visible text of a page, one line per block."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    t = F.regexp_replace(F.regexp_replace(t, _BLOCKS, "\n"), r"(?s)<[a-zA-Z/!?][^>]*>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t\\r\\x0B\\f ]+", " "), " ?\\n[ \\n]*", "\n")
    return F.btrim(t, F.lit(" \n"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def record_id(kind: str, name: Column) -> Column:
    """UUID from an md5, so that it doesn't depend on the run."""
    h = F.md5(F.concat(F.lit(f"{kind} "), name).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def responses(pages: DataFrame, date: str = NO_DATE, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Response records of fetched pages: page_id, record_id, target_uri, date, http (status line and headers), body, digests."""
    url, body = F.coalesce(pages[url_col], F.lit("")), F.coalesce(pages[body_col], F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(body).cast("string"))
    name = F.concat_ws(" ", F.coalesce(pages[id_col].cast("string"), F.lit("null")), url)
    rows = pages.select(pages[id_col].alias("page_id"), record_id("response", name).alias("record_id"), url.alias("target_uri"),
                        F.lit(date).alias("date"), http.alias("http"), body.alias("body"))
    whole = F.concat("http", F.lit(END + END), "body")
    return rows.withColumn("block_digest", digest(whole)).withColumn("payload_digest", digest(F.col("body")))


def derive(source: DataFrame) -> DataFrame:
    """Two records per response: page_id, type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest,
    payload_digest, block. The date of the source is the date of both (the writer also states it as WARC-Refers-To-Date)."""
    text = plain_text(F.col("body"))
    title = F.btrim(F.regexp_replace(F.regexp_extract("body", r"(?is)<title[^>]*>([^<]*)", 1), "[ \\t\\r\\n]+", " "), F.lit(" "))
    kept = F.regexp_replace(F.regexp_replace("http", "^[^\\r\\n]*\\r\\n", ""), "(?m)^", "source-header-")
    fields = F.concat_ws(
        END, F.concat(F.lit("source-record-id: "), "record_id"), F.concat(F.lit("source-status: "), F.regexp_extract("http", "^HTTP/[0-9.]+ ([0-9]+)", 1)), kept,
        F.concat(F.lit("source-block-digest: "), "block_digest"), F.concat(F.lit("source-payload-digest: "), "payload_digest"),
        F.concat(F.lit("title: "), title), F.concat(F.lit("text-digest: "), digest(F.col("_text"))), F.concat(F.lit("text-chars: "), F.char_length("_text").cast("string")))
    made = source.withColumn("_text", text)
    made = made.withColumn("_fields", F.concat(fields, F.lit(END)))
    both = F.explode(F.array(
        F.struct(F.lit("metadata").alias("type"), record_id("metadata", F.col("record_id")).alias("record_id"),
                 F.lit("application/warc-fields").alias("content_type"), F.col("_fields").alias("block")),
        F.struct(F.lit("conversion").alias("type"), record_id("conversion", F.col("record_id")).alias("record_id"),
                 F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block"))))
    made = made.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", both.alias("r"))
    return made.select("page_id", "r.type", "r.record_id", "refers_to", "target_uri", "date", "r.content_type", F.octet_length("r.block").cast("long").alias("content_length"),
                       digest(F.col("r.block")).alias("block_digest"), "payload_digest", "r.block")


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Derived records as WARC files, one per partition."""
    head = [("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
            ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Refers-To-Date", "date"), ("WARC-Block-Digest", "block_digest"),
            ("X-Source-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = [F.concat(F.lit(f"{name}: "), F.col(col).cast("string")) for name, col in head]
    record = F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *lines), F.lit(END + END), F.col("block"))
    records.select(record.alias("value")).write.option("lineSep", END + END).option("compression", compression).text(path)


_CUT = f"{END}{END}WARC/1."


def _stated(piece: bytes) -> tuple[int, int] | None:
    """Bytes of the block that a record states, and those that the piece has; None if it isn't a record."""
    head, sep, body = piece.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if sep and name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), len(body)
    return None


def _rejoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in file order, to whole records: a piece that is too short takes the pieces after it, if the lengths then agree."""
    file, waiting = None, []

    def settle(whole: bool) -> list[bytes]:
        """Records that the waiting pieces give; with ``whole``, no further piece of the file comes."""
        out = []
        while waiting:
            stated = _stated(waiting[0])
            size, have, n = (*stated, 1) if stated else (0, 0, 1)
            while have < size and n < len(waiting):
                have, n = have + len(_CUT) + len(waiting[n]), n + 1
            if have < size and not whole:
                return out
            last = whole and n == len(waiting)
            met = have == size or (last and size <= have <= size + 2 * len(END))
            out.append(_CUT.encode().join(waiting[:n]) if n > 1 and met else waiting[0])
            del waiting[:n if met else 1]
        return out

    def batch(values: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(values, pa.binary())], names=["value"])

    for b in batches:
        for name, value in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
            if name != file:
                if done := settle(True):
                    yield batch(done)
                file = name
            waiting.append(value)
            if done := settle(False):
                yield batch(done)
    if done := settle(True):
        yield batch(done)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: headers (map of lower-case names), block (binary), and whether the block has the stated length.

    Files are cut at record starts wherever they lie, so a large plain file is read by many tasks. Content-Length decides: where a block itself
    holds an empty line followed by ``WARC/1.``, the pieces of that file are put in order again and rejoined. A record whose length
    can't be met shows as not intact.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")]
    raw = spark.read.option("lineSep", _CUT).text(path).select(*place, "value").filter(F.col("value") != "")
    records = _parsed(raw.select("file", "start", "at", "value"))
    broken = records.filter(~F.col("intact")).select("file").distinct()
    whole = records.join(broken, "file", "left_anti").select("headers", "block", "intact")
    pieces = raw.join(broken, "file", "left_semi").select("file", "start", "at", F.col("value").cast("binary").alias("value"))
    pieces = pieces.repartition("file").sortWithinPartitions("file", "start", "at").mapInArrow(_rejoined, "value binary")
    again = _parsed(pieces.select(F.lit("").alias("file"), F.col("value").cast("string").alias("value"))).select("headers", "block", "intact")
    return whole.unionByName(again)


def _parsed(raw: DataFrame) -> DataFrame:
    at = F.instr("value", END + END)
    head = F.split(F.substring_index("value", END + END, 1), END)
    pairs = F.transform(F.filter(F.slice(head, 2, F.size(head)), lambda x: F.instr(x, ":") > 0), lambda x: F.struct(
        F.lower(F.btrim(F.substring_index(x, ":", 1))).alias("key"), F.btrim(x.substr(F.instr(x, ":") + 1, F.length(x))).alias("value")))
    body = F.col("value").cast("binary").substr(F.octet_length(F.substring_index("value", END + END, 1)) + 5, F.octet_length("value"))
    rows = raw.filter(at > 0).select("file", F.map_from_entries(pairs).alias("headers"), body.alias("body"))
    size = F.element_at("headers", "content-length").cast("int")
    return rows.select("file", "headers", F.col("body").substr(F.lit(1), size).alias("block"), F.coalesce(F.octet_length("body") >= size, F.lit(False)).alias("intact"))


def source_responses(records: DataFrame, damaged: str = "refuse") -> DataFrame:
    """Response records read from WARC files in the form that ``derive`` takes (page_id is the record id).

    A response that is not intact is refused; with ``damaged="skip"`` it is left out, and ``records.filter(~intact)`` has it.
    """
    if damaged not in ("refuse", "skip"):
        raise ValueError(f"unknown rule {damaged}")
    h = lambda name: F.element_at("headers", name)
    block = F.col("block").cast("string")
    rows = records.filter(h("warc-type") == "response")
    if damaged == "refuse" and (lost := rows.filter(~F.col("intact")).select(h("warc-record-id")).first()):
        raise ValueError(f"damaged record {lost[0]}")
    rows = rows.filter("intact")
    http = F.substring_index(block, END + END, 1)
    body = F.when(F.instr(block, END + END) > 0, block.substr(F.length(http) + 5, F.length(block))).otherwise("")
    return rows.select(h("warc-record-id").alias("page_id"), h("warc-record-id").alias("record_id"), F.coalesce(h("warc-target-uri"), F.lit("")).alias("target_uri"),
                       F.coalesce(h("warc-date"), F.lit(NO_DATE)).alias("date"), http.alias("http"), body.alias("body"),
                       F.coalesce(h("warc-block-digest"), digest(block)).alias("block_digest"), F.coalesce(h("warc-payload-digest"), digest(body)).alias("payload_digest"))
