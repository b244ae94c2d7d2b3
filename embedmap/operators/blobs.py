"""Blob packs: byte offsets, spans, manifests and receipts; url and size sidecars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embedmap.functions import codec
from embedmap.operators.ordering import HOT_ROWS, id_bucket, limit_per_group, md5_priority, running_total

# Fixed limits of the formats.
MAX_SPAN = 1 << 20
MAX_SIDE = 65535
MAX_URL = 65535
MAX_URL_BLOB = (1 << 32) - 1
OFFSET_BYTES = 8


def pack_offsets(payloads: DataFrame, shard: Sequence[str] = ("shard",), local: str = "local", split_bits: int = 16, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Start and end byte of every payload in its shard; a missing payload has a zero-length span.

    payloads: shard, local, n_bytes (null when missing). A crowded shard is split by ranges of its local rows.
    """
    sized = payloads.select(*shard, local, F.coalesce("n_bytes", F.lit(0)).cast("long").alias("_size"))
    out = running_total(sized, list(shard), [local], F.col("_size"), "start", id_bucket(local, split_bits), hot_rows)
    return out.select(*shard, local, F.col("start").cast("long").alias("start"), (F.col("start") + F.col("_size")).cast("long").alias("end"))


def lookup_spans(offsets: DataFrame, refs: DataFrame) -> DataFrame:
    """Span of packed references; an unknown or missing one is empty. refs: ref, or ref with the shard and local row it stands for.

    A local row beyond the 16 bits of its field can't be told from the next shard in the number, so its address is given beside it.
    """
    if not {"shard", "local"} <= set(refs.columns):
        shard, local = codec.unpack_ref(F.col("ref"))
        refs = refs.withColumns({"shard": shard, "local": local})
    zero = F.lit(0).cast("long")
    return refs.join(offsets, ["shard", "local"], "left").select(
        "ref", F.coalesce("start", zero).alias("start"), F.coalesce(F.col("end") - F.col("start"), zero).alias("length")
    )


def check_offsets(offsets: DataFrame, shards: DataFrame, max_span: int = MAX_SPAN, split_bits: int = 16, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Violations per shard. offsets: shard, local, start, end; shards: shard, n_rows, n_bytes as declared."""
    size = F.col("end") - F.col("start")
    # Spans follow each other without gaps exactly if every start is the sum of the sizes before it.
    summed = running_total(offsets, ["shard"], ["local"], size, "_sum", id_bucket("local", split_bits), hot_rows)
    per_row = summed.withColumns({"_gap": F.col("_sum") != F.col("start"), "_bad": size < 0, "_big": size > max_span})
    agg = per_row.groupBy("shard").agg(
        F.count_if("_gap").alias("gaps"), F.count_if("_bad").alias("negative"), F.count_if("_big").alias("oversize"),
        F.max("end").alias("_end"), F.count(F.lit(1)).alias("_n"),
    )
    joined = shards.join(agg, "shard", "full")
    rules = {
        "missing shard": F.col("_n").isNull(), "unknown shard": F.col("n_rows").isNull(), "not contiguous": F.col("gaps") > 0,
        "decreasing": F.col("negative") > 0, "span too large": F.col("oversize") > 0, "wrong size": F.col("_end") != F.col("n_bytes"),
        "wrong row count": F.col("_n") != F.col("n_rows"),
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return joined.select("shard", F.explode(flags).alias("problem"))


def shard_manifest(offsets: DataFrame) -> DataFrame:
    """Rows, payload bytes and offset-table bytes per shard."""
    return offsets.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.max("end").alias("n_bytes")).withColumn(
        "offset_bytes", (F.col("n_rows") + 1) * OFFSET_BYTES
    )


def corpus_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("n_shards"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"),
        F.sum("offset_bytes").alias("offset_bytes"),
    )


def build_receipts(src: DataFrame, dst: DataFrame, identity: str) -> DataFrame:
    """Receipt per shard: valid and missing rows, source and target bytes, order-free digest, build identity.

    src, dst: shard, local, payload (binary, null or empty when missing).
    """
    size = lambda: F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    a = src.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size()).alias("source_bytes"))
    digest = F.sum(F.xxhash64("local", "payload").cast("decimal(38,0)")).cast("string")
    b = dst.groupBy("shard").agg(
        F.count_if(size() > 0).alias("n_valid"), F.sum(size()).alias("target_bytes"), digest.alias("digest")
    )
    return a.join(b, "shard", "left").na.fill(0, ["n_valid", "target_bytes"]).withColumns(
        {"n_missing": F.col("n_rows") - F.col("n_valid"), "identity": F.lit(identity)}
    )


def pending_shards(shards: DataFrame, receipts: DataFrame, identity: str) -> DataFrame:
    """Shards without a finished receipt. A receipt of another build stops the job that reads this."""
    other = F.raise_error(F.concat(F.lit("receipt of another build: "), F.col("identity"))).cast("boolean")
    done = receipts.filter(F.when(F.col("identity") == identity, F.lit(True)).otherwise(other)).select("shard")
    return shards.join(done, "shard", "left_anti")


def release_progress(receipts: DataFrame, manifest: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Completed shards, rows and bytes against the manifest; ``over_ceiling`` when the bytes exceed the size ceiling."""
    done = receipts.select("shard", F.col("n_rows").alias("_rows"), F.col("target_bytes").alias("_bytes"))
    out = manifest.join(done, "shard", "left").agg(
        F.count(F.lit(1)).alias("expected_shards"), F.count("_rows").alias("completed_shards"), F.sum("n_rows").alias("expected_rows"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("completed_rows"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("completed_bytes"),
    )
    complete = (F.col("completed_shards") == F.col("expected_shards")) & (F.col("completed_rows") == F.col("expected_rows"))
    over = F.col("completed_bytes") > max_bytes if max_bytes is not None else F.lit(False)
    return out.withColumns({"complete": complete, "over_ceiling": over})


# --- urls and sizes ---------------------------------------------------------------------------------------------------

def clamp_side(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")), F.lit(MAX_SIDE).cast("long"))


def encode_urls(points: DataFrame, split_bits: int = 20, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Offset and length of every url in one blob in row order; null and empty urls have length 0; sides are clamped.

    The prefix sum over all rows is two-level: inside ranges of row ids, then over the range totals. points: row_id
    (dense), url, width, height.
    """
    length = F.coalesce(F.octet_length("url"), F.lit(0)).cast("long")
    too_long = F.raise_error(F.lit("url longer than 65535 bytes")).cast("long")
    sized = points.withColumn("url_len", F.when(length <= MAX_URL, length).otherwise(too_long))
    out = running_total(sized, [], ["row_id"], F.col("url_len"), "url_offset", id_bucket("row_id", split_bits), hot_rows)
    return out.select("row_id", "url", F.col("url_offset").cast("long").alias("url_offset"), "url_len", clamp_side(F.col("width")).alias("width"),
                      clamp_side(F.col("height")).alias("height"))


def beyond_u32(encoded: DataFrame) -> DataFrame:
    """Rows whose url ends beyond the reach of 32-bit offsets; a sidecar with such offsets needs none."""
    return encoded.filter(F.col("url_offset") + F.col("url_len") > MAX_URL_BLOB).select("row_id", "url_offset", "url_len")


def lookup_meta(meta: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Url (null when empty) and size by row; ``in_range`` is false outside 0..n-1."""
    out = rows.join(meta.select("row_id", F.nullif("url", F.lit("")).alias("url"), "width", "height"), "row_id", "left")
    return out.withColumn("in_range", F.col("row_id").between(0, n - 1))


def meta_summary(meta: DataFrame) -> DataFrame:
    return meta.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("url_len") > 0).alias("n_with_url"), F.sum("url_len").alias("url_bytes"))


def pilot_estimate(rows: DataFrame, n_shards: int, rows_per_shard: int, seed: int) -> DataFrame:
    """Seeded pilot: some shards, some rows of each; ratio of target to source bytes applied to the whole.

    rows: shard, local, source_bytes, target_bytes.
    """
    shards = rows.groupBy("shard").agg(F.sum("source_bytes").alias("_total"))
    chosen = shards.orderBy(md5_priority(seed, "shard"), "shard").limit(n_shards).select("shard")
    picked = rows.join(F.broadcast(chosen), "shard", "left_semi").withColumn("_p", md5_priority(seed, "shard", "local"))
    sample = limit_per_group(picked, ["shard"], ["_p", "local"], rows_per_shard)
    one = sample.agg(
        F.count(F.lit(1)).alias("n_sampled"), F.sum("source_bytes").alias("sample_source"), F.sum("target_bytes").alias("sample_target"),
        F.lit(0).alias("_k"),
    )
    whole = shards.agg(F.sum("_total").alias("source_total"), F.lit(0).alias("_k"))
    ratio = F.col("sample_target") / F.col("sample_source")
    return one.join(whole, "_k").drop("_k").withColumns({"ratio": ratio, "estimate": ratio * F.col("source_total")})


def pack_subset_shards(payloads: DataFrame, shard_rows: int = 2048) -> DataFrame:
    """Fixed-size shards inside each subset: shard, offset and length per id. payloads: subset, id (dense per subset), n_bytes.

    An empty or oversize payload stops the job that reads this.
    """
    bad = F.raise_error(F.lit("empty or oversize payload")).cast("long")
    size = F.when(F.col("n_bytes").between(1, MAX_SPAN), F.col("n_bytes").cast("long")).otherwise(bad)
    shard = F.call_function("div", F.col("id"), F.lit(shard_rows).cast("long"))
    sized = payloads.withColumns({"shard": shard, "n_bytes": size})
    spans = pack_offsets(sized, ["subset", "shard"], "id")
    return spans.select("subset", "shard", "id", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"))


def dense_per_subset(payloads: DataFrame) -> DataFrame:
    """Subsets whose ids are not exactly 0..n-1."""
    per_id = payloads.groupBy("subset", "id").agg(F.count(F.lit(1)).alias("_c"))
    agg = per_id.groupBy("subset").agg(
        F.sum("_c").alias("n_rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n_ids")
    )
    return agg.filter((F.col("min_id") != 0) | (F.col("max_id") != F.col("n_rows") - 1) | (F.col("n_ids") != F.col("n_rows")))


def harvest_manifest(expected: DataFrame, receipts: DataFrame) -> DataFrame:
    """Expected shards with their receipts; a shard without one is flagged. receipts: shard, rows, bytes, failed, with_url."""
    cols = ["rows", "bytes", "failed", "with_url"]
    out = expected.join(receipts.select("shard", *cols), "shard", "left")
    return out.withColumn("missing", F.col("rows").isNull()).na.fill(0, cols)


def harvest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("n_shards"), F.count_if("missing").alias("n_missing"),
        *[F.sum(c).alias(c) for c in ("rows", "bytes", "failed", "with_url")],
    )
