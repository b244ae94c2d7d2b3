"""Identity: validated keys and joins, dictionary codes, samples, collision-preserving mappings.

Every check returns a violations table (empty when the contract holds) or a one-row report; ``require_empty`` turns
a violations table into a refusal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.functions import codec
from embedmap.operators.ordering import id_bucket, limit_per_group, md5_priority, running_total, small

MISSING = -1
DICTIONARY_LIMIT = 16


class ContractError(ValueError):
    pass


def require_empty(violations: DataFrame, message: str) -> None:
    """Refuse when a violations table has a row; only the first rows reach the driver, as the error text."""
    rows = violations.take(3)
    if rows:
        raise ContractError(f"{message}: {rows}")


def check_dense(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """One row: count, bounds, duplicated keys, and whether the key is exactly 0..n-1 (n defaults to the count)."""
    per_key = df.groupBy(F.col(col).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    out = per_key.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n_rows"),
        F.min("_k").alias("min_key"),
        F.max("_k").alias("max_key"),
        F.count_if(F.col("_c") > 1).alias("n_duplicated"),
    )
    size = F.lit(n).cast("long") if n is not None else F.col("n_rows")
    dense = (
        (F.col("n_rows") == size) & (F.col("n_duplicated") == 0)
        & ((size == 0) | ((F.col("min_key") == 0) & (F.col("max_key") == size - 1)))
    )
    return out.withColumn("dense", F.coalesce(dense, F.lit(False)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the number of extra rows."""
    return (
        df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra")).filter(F.col("extra") > 0)
    )


def one_to_one_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations of a one-to-one join: duplicated keys of either side and keys without partner."""
    tag = lambda df, kind: df.select(*keys, F.lit(kind).alias("problem"))
    ln, rn = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c)) for df, c in ((left, "_l"), (right, "_r"))
    )
    both = ln.join(rn, list(keys), "full")
    return (
        tag(both.filter(F.col("_l") > 1), "duplicate left")
        .unionByName(tag(both.filter(F.col("_r") > 1), "duplicate right"))
        .unionByName(tag(both.filter(F.col("_r").isNull()), "left only"))
        .unionByName(tag(both.filter(F.col("_l").isNull()), "right only"))
    )


def one_to_one_join(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    if check:
        require_empty(one_to_one_report(left, right, keys), "join is not one to one")
    return left.join(right, list(keys))


def enrich_left(points: DataFrame, lookup: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Row-preserving enrichment with url, width, height: empty url is null, sizes are at least 0."""
    if check:
        require_empty(duplicate_keys(lookup, keys), "lookup key is not unique")
    zero = F.lit(0).cast("long")
    return (
        points.join(lookup.select(*keys, "url", "width", "height"), list(keys), "left")
        .withColumn("url", F.nullif(F.col("url"), F.lit("")))
        .withColumns({c: F.greatest(zero, F.coalesce(F.col(c).cast("long"), zero)) for c in ("width", "height")})
    )


def checked_mapping(mapping: Mapping[str, int], previous: Mapping[str, int] | None = None) -> dict[str, int]:
    """A frozen dictionary: codes 0..15, unique; an extension may only append to the previous one."""
    codes = list(mapping.values())
    if len(set(codes)) != len(codes) or any(not 0 <= c < DICTIONARY_LIMIT for c in codes):
        raise ContractError("codes must be unique and within 0..15")
    if previous and any(mapping.get(k) != v for k, v in previous.items()):
        raise ContractError("existing codes may not change")
    return dict(mapping)


def _code(col: str, mapping: Mapping[str, int]) -> Column:
    pairs = [F.lit(x) for kv in checked_mapping(mapping).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(col)).cast("long")


def unknown_values(df: DataFrame, col: str, mapping: Mapping[str, int]) -> DataFrame:
    return df.filter(_code(col, mapping).isNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))


def encode_subset(df: DataFrame, col: str, mapping: Mapping[str, int], out: str = "code") -> DataFrame:
    """Dictionary code as a map literal of at most 16 entries; an unknown value stops the job that reads it."""
    code = _code(col, mapping)
    failed = F.raise_error(F.concat(F.lit(f"unknown {col}: "), F.coalesce(F.col(col), F.lit("null")))).cast("long")
    return df.withColumn(out, F.coalesce(code, failed))


def ref_violations(df: DataFrame, shard: str, local: str) -> DataFrame:
    return df.filter(~F.coalesce(codec.ref_in_range(F.col(shard), F.col(local)), F.lit(False)))


def refusing_join(left: DataFrame, right: DataFrame, on: Sequence[str], message: str) -> DataFrame:
    """Inner join that stops the job at a left row without a partner, instead of losing it."""
    mark = "_partner"
    joined = left.join(right.withColumn(mark, F.lit(True)), list(on), "left")
    seen = F.when(F.col(mark), F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit(message), *[F.col(c).cast("string") for c in on])).cast("boolean"))
    return joined.filter(seen).drop(mark)


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The left rows that ``refusing_join`` would stop at."""
    return left.join(right, list(on), "left_anti")


def select_draw(pool: DataFrame, idx: DataFrame) -> DataFrame:
    """Metadata of drawn pool rows in draw order; a drawn row that the pool lacks stops the job. ``idx``: row_id (dense), pool_row."""
    return refusing_join(idx, pool, ["pool_row"], "drawn row is not in the pool")


def draw_violations(idx: DataFrame) -> DataFrame:
    """Draw entries that do not exceed their predecessor; the predecessor is found by an equi join on row_id."""
    nxt = idx.select((F.col("row_id") + 1).alias("row_id"), F.col("pool_row").alias("previous"))
    return idx.join(nxt, "row_id").filter(F.col("pool_row") <= F.col("previous"))


def gather_by_ref(points: DataFrame, store: DataFrame) -> DataFrame:
    """url, width, height of (shard, local_row) references; sides below 0 become 0, a reference without a row stops the job.

    The row is part of the key, so a hot shard is spread evenly. ``missing_refs`` lists what would be refused.
    """
    side = lambda c: F.greatest(F.col(c), F.lit(0).cast(store.schema[c].dataType)).alias(c) if c in ("width", "height") else F.col(c)
    return refusing_join(points, store.select(*[side(c) for c in store.columns]), ["shard", "local_row"], "reference without a stored row")


def missing_refs(points: DataFrame, shard_rows: DataFrame) -> DataFrame:
    """References to a shard that is not stored, or to a row beyond its end. ``shard_rows``: shard, n_rows."""
    joined = points.join(small(shard_rows), "shard", "left")
    problem = F.when(F.col("n_rows").isNull(), "missing shard").when(F.col("local_row") >= F.col("n_rows"), "row beyond shard")
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def provenance_join(training: DataFrame, pool: DataFrame, paths: DataFrame) -> DataFrame:
    """Pool row of every training row by (shard path, local row). ``agrees`` tells whether the image ids match.

    training: row_id, path, local_row, image_id; pool: pool_row, shard, local_row, pool_id; paths: shard, path.
    """
    located = pool.join(small(paths), "shard").select("path", "local_row", "pool_row", "pool_id")
    return training.join(located, ["path", "local_row"], "left").select(
        "row_id", "pool_row", F.coalesce(F.col("image_id") == F.col("pool_id"), F.lit(False)).alias("agrees")
    )


def provenance_violations(joined: DataFrame) -> DataFrame:
    per_row = joined.groupBy("pool_row").agg(F.count(F.lit(1)).alias("uses"))
    wrong = joined.filter(~F.col("agrees")).select("row_id", "pool_row", F.lit("id mismatch").alias("problem"))
    repeated = joined.join(per_row.filter((F.col("uses") > 1) & F.col("pool_row").isNotNull()), "pool_row").select(
        "row_id", "pool_row", F.lit("pool row used twice").alias("problem")
    )
    return wrong.unionByName(repeated)


def map_source_rows(df: DataFrame, shard_stats: DataFrame) -> DataFrame:
    """Global source row of (shard, local_row), with a flag for addresses outside the shard or of another category.

    ``shard_stats``: shard, first_row, n_rows, shard_category; one row per shard.
    """
    ok = F.col("n_rows").isNotNull() & (F.col("local_row") < F.col("n_rows")) & (F.col("local_row") >= 0) & (
        F.col("category") == F.col("shard_category")
    )
    return df.join(small(shard_stats), "shard", "left").select(
        *df.columns, (F.col("first_row") + F.col("local_row")).alias("source_row"), F.coalesce(ok, F.lit(False)).alias("valid")
    )


def concat_corpora(parts: Sequence[tuple[DataFrame, int]], id_col: str = "row_id") -> DataFrame:
    """Corpora one after the other: the ids of each are shifted by the sizes before it. ``parts``: (rows, size)."""
    offset, out = 0, None
    for df, size in parts:
        shifted = df.withColumn(id_col, F.col(id_col) + F.lit(offset).cast("long"))
        out = shifted if out is None else out.unionByName(shifted)
        offset += size
    return out


def extend_metadata(meta: DataFrame, n: int) -> DataFrame:
    """Metadata for rows 0..n-1; rows without an entry are explicitly empty. ``meta``: row_id, url, url_len, width, height."""
    ids = meta.sparkSession.range(n).withColumnRenamed("id", "row_id")
    return ids.join(meta, "row_id", "left").na.fill(0, ["url_len", "width", "height"])


# --- identity across three tables -------------------------------------------------------------------------------------

PATH_PREFIX = "^v1\\.2\\.0/"  # fixed value: release prefix of stored shard paths


def identity_rows(map_rows: DataFrame, paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """Perceptual hash of every map row: (path, id) located in the catalogue. Unmatched rows keep a null hash.

    map_rows: row_id, shard, image_id; paths: shard, path; catalog: path, image_id, hash.
    """
    stripped = paths.select("shard", F.regexp_replace("path", PATH_PREFIX, "").alias("path"))
    return map_rows.join(small(stripped), "shard", "left").join(catalog, ["path", "image_id"], "left").select("row_id", "hash")


def unmatched_identity(rows: DataFrame, ann: DataFrame) -> DataFrame:
    """Map rows without hash and ANN ids whose hash no row has."""
    lost = rows.filter(F.col("hash").isNull()).select(F.col("row_id").alias("id"), F.lit("row").alias("side"))
    alone = ann.join(rows.select("hash"), "hash", "left_anti").select(F.col("ann_id").alias("id"), F.lit("ann").alias("side"))
    return lost.unionByName(alone)


def collision_map(rows: DataFrame, ann: DataFrame) -> DataFrame:
    """ANN id to row: the row when its hash has exactly one, else MISSING with the size of the candidate list.

    Candidate lists stay in ``collision_candidates``, once per hash: a hash shared by k rows and k ids costs 2k rows here,
    never k*k pairs.
    """
    # A row id that is listed twice is one candidate.
    once = rows.filter(F.col("hash").isNotNull()).groupBy("hash", "row_id").agg(F.lit(1).alias("_one"))
    per_hash = once.groupBy("hash").agg(F.count(F.lit(1)).alias("n_candidates"), F.min("row_id").alias("_row"))
    row = F.when(F.col("n_candidates") == 1, F.col("_row")).otherwise(F.lit(MISSING).cast("long"))
    joined = ann.join(per_hash, "hash", "left")
    return joined.select(
        "ann_id", "hash", row.alias("row_id"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates")
    )


def collision_candidates(rows: DataFrame) -> DataFrame:
    """Rows that share their hash with another row, once each."""
    shared = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("hash")
    return rows.join(shared, "hash").select("hash", "row_id")


def resolve_collisions(mapping: DataFrame, candidates: DataFrame, ann_codes: DataFrame, row_codes: DataFrame) -> DataFrame:
    """Resolve MISSING entries by equality of the stored codes among the candidates of the same hash.

    status: resolved (exactly one match), unresolved (several), no match.
    """
    per_code = (
        candidates.join(row_codes, "row_id").groupBy("hash", "code")
        .agg(F.count(F.lit(1)).alias("n_matches"), F.min("row_id").alias("_row"))
    )
    open_ids = mapping.filter((F.col("row_id") == MISSING) & (F.col("n_candidates") > 1)).select("ann_id", "hash")
    n = F.coalesce("n_matches", F.lit(0)).cast("long")
    return open_ids.join(ann_codes, "ann_id").join(per_code, ["hash", "code"], "left").select(
        "ann_id",
        F.when(n == 1, F.col("_row")).otherwise(F.lit(MISSING).cast("long")).alias("row_id"),
        n.alias("n_matches"),
        F.when(n == 1, "resolved").when(n == 0, "no match").otherwise("unresolved").alias("status"),
    )


def check_permutation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Both columns must be exactly 0..n-1."""
    report = lambda c: check_dense(df.select(c), c).withColumn("key", F.lit(c)).select(
        "key", "n_rows", "min_key", "max_key", "n_duplicated", "dense"
    )
    return report(a).unionByName(report(b))


def verify_row_order(points: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows whose packed reference differs from the one their position in shard order implies.

    points: row_id, ref; shards: seq (not negative), shard, n_rows. Starts are summed in ranges of seq.
    """
    starts = running_total(shards, [], ["seq"], F.col("n_rows"), "start", id_bucket("seq", 16)).withColumn("start", F.col("start").cast("long"))
    shard, local = codec.unpack_ref(F.col("ref"))
    located = points.withColumn("shard", shard).withColumn("local", local).join(
        starts.select("shard", "start", "n_rows"), "shard", "left"
    )
    wrong = F.col("start").isNull() | (F.col("local") >= F.col("n_rows")) | (F.col("row_id") != F.col("start") + F.col("local"))
    return located.filter(wrong).select("row_id", "ref")


# --- samples ----------------------------------------------------------------------------------------------------------

def stratified_sample(df: DataFrame, by: str, k: int, seed: int | str, id_col: str = "row_id") -> DataFrame:
    """k rows per stratum by a seeded hash of the key; independent of partitioning."""
    prio = df.withColumn("_prio", md5_priority(seed, id_col))
    return limit_per_group(prio, [by], ["_prio", id_col], k).drop("_prio", "rank")


def training_sample(df: DataFrame, heldout: DataFrame, m: int, seed: int | str, id_col: str = "row_id") -> DataFrame:
    """m rows outside the held-out set by a seeded hash of the key."""
    rest = df.join(heldout.select(id_col), id_col, "left_anti")
    return rest.withColumn("_prio", md5_priority(seed, id_col)).orderBy("_prio", id_col).limit(m).drop("_prio")
