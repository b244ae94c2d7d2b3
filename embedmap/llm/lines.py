"""Line deduplication over a whole corpus with DataFrame functions only.

Every line has a key: the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points are hashed to 128 bits, and rows (hash, document, position) are range-partitioned by hash and
sorted within each partition by hash, then by document from the largest id down, then by position. In that stream the first
document of a hash is the one that keeps its lines; if the hash is found in ``min_docs`` documents, the lines of all later
ones are dropped. What comes back per document is a compressed bitmap of its lines: 63 lines to a word, and only the words in
which a line is dropped. No text is shuffled before the bitmaps meet it.

Hot hashes: counts of 65,536 hash ranges show where rows pile up. Rows of a crowded range carry a lane taken from the
document id, the stream is cut by (hash, lane), and a table of one row per hash and lane gives all lanes the first
document and the number of documents of the whole hash.

Defined cases: a null or empty text is one empty line; a null id counts as one document below all others; rows with one id are one
document, and each of them keeps the lines that its id keeps; repeated lines of the keeping document all stay; an empty
table gives no rows; other columns of the input, whatever their names, pass through (one named ``_lines`` gives way to the result).
The bitmaps hold the lines that go; all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedmap.llm.tables import carried, released, stored

MIN_CHARS = 20
MIN_DOCS = 3
#: Lines per bitmap word (the sign bit stays free).
WORD = 63
#: A hash range is crowded if it has more rows than this and than ``TIMES_MEAN`` mean ranges; a lane has a quarter of that.
CROWDED = 4096
TIMES_MEAN = 8
RANGES = 1 << 16

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAST = -(1 << 63)


def line_key(line: Column) -> Column:
    """Stripped line with A-Z lower-cased; other letters keep their case."""
    bare = F.btrim(line, F.lit(_SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, sig, pos, h1, h2) of every line whose key is long enough; sig tells apart rows of one id."""
    doc = F.coalesce(docs[id_col].cast("long"), F.lit(_LEAST))
    lines = docs.select(doc.alias("doc"), F.xxhash64(docs[text_col]).alias("sig"), F.posexplode(lines_of(docs[text_col])).alias("pos", "line"))
    keyed = lines.filter(F.char_length("line") >= min_chars).select("doc", "sig", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        "doc", "sig", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS, crowded: int = CROWDED) -> DataFrame:
    """(doc, sig, pos) of the lines that go."""
    spread = F.shiftrightunsigned("h1", 48)
    limit = max(crowded, TIMES_MEAN * lines.count() // RANGES)
    ranges = lines.groupBy(spread.alias("range")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    ranges = ranges.select("range", F.ceil(4 * F.col("n") / limit).alias("lanes"))  # at most RANGES / TIMES_MEAN rows
    lane = F.when(F.col("lanes").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("doc"), F.col("lanes")))
    dealt = lines.withColumn("range", spread).join(F.broadcast(ranges), "range", "left").select("doc", "sig", "pos", "h1", "h2", lane.alias("lane"))

    def streamed(rows: DataFrame) -> DataFrame:
        """First document and number of documents of each (hash, lane), by one pass over the sorted partition."""
        rows = rows.repartitionByRange("h1", "h2", "lane")
        run = Window.partitionBy("h1", "h2", "lane").orderBy(F.desc("doc"), "pos")
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        begins = F.when(F.lag("doc").over(run) == F.col("doc"), 0).otherwise(1)
        return rows.withColumn("begins", begins).withColumn("docs", F.sum("begins").over(whole)).withColumn("first", F.first("doc").over(whole))

    goes = (F.col("docs") >= min_docs) & (F.col("doc") < F.col("first"))
    alone = streamed(dealt.filter(F.col("lane") < 0)).filter(goes).select("doc", "sig", "pos")
    crowd = dealt.filter(F.col("lane") >= 0)
    per_lane = streamed(crowd).groupBy("h1", "h2", "lane").agg(F.max("docs").alias("docs"), F.max("first").alias("first"))
    every = Window.partitionBy("h1", "h2")
    totals = per_lane.select("h1", "h2", "lane", F.sum("docs").over(every).alias("docs"), F.max("first").over(every).alias("first"))
    crowded_rows = crowd.join(totals, ["h1", "h2", "lane"]).filter(goes).select("doc", "sig", "pos")
    return alone.unionByName(crowded_rows)


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, sig, drops): the words of each document's bitmap that have a dropped line, as (word, bits)."""
    word, bit = F.floor(F.col("pos") / WORD).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(WORD)).cast("int"))
    words = dropped.groupBy("doc", "sig", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc", "sig").agg(F.collect_list(F.struct("word", "bits")).alias("drops"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, crowded: int = CROWDED,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compressed bitmaps (doc, sig, drops) of all documents that lose a line."""
    lines = stored(hashed_lines(docs, min_chars, id_col, text_col))
    return drop_bitmaps(dropped_lines(lines, min_docs, crowded))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "_lines") -> DataFrame:
    """``docs`` with the struct ``into``: n_lines, n_dropped and the text that stays."""
    marked = carried(docs, into, doc=F.coalesce(docs[id_col].cast("long"), F.lit(_LEAST)), sig=F.xxhash64(docs[text_col]))
    joined = marked.join(bitmaps.hint("shuffle_hash"), ["doc", "sig"], "left").select("row", "drops")
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    # The sparse words as a dense array, so that a line finds its bit at once.
    dense = F.transform(F.sequence(F.lit(0), F.floor((F.size("split") - 1) / WORD).cast("int")),
                        lambda w: F.coalesce(F.element_at("by_word", w), F.lit(0).cast("long")))
    stays = F.filter("split", lambda line, i: F.call_function(
        "getbit", F.element_at("dense", (F.floor(i / WORD) + 1).cast("int")), F.pmod(i, F.lit(WORD)).cast("int")) == 0)
    changed = F.col("drops").isNotNull()
    out = joined.withColumn("split", F.split(text, "\n", -1)).withColumn("by_word", F.map_from_entries("drops"))
    out = out.withColumn("dense", F.when(changed, dense)).withColumn("kept", F.when(changed, stays))
    result = F.struct(
        F.size("split").cast("long").alias("n_lines"),
        F.when(changed, F.size("split") - F.size("kept")).otherwise(0).cast("long").alias("n_dropped"),
        F.when(changed, F.array_join("kept", "\n")).otherwise(text).alias("text"))
    return released(out, docs.columns, into, result)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "_lines", **limits: int) -> DataFrame:
    """``docs`` with the struct ``into`` (n_lines, n_dropped, text)."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col=id_col, text_col=text_col, **limits), id_col, text_col, into)
