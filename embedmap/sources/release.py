"""Contract-checked rebuilds and immutable releases.

A release is a folder of tables. Its manifest is written last, so a release without a manifest does not exist for readers
and a failed build leaves the previous release as it was. Object stores have no atomic rename, and none is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedmap.operators.keys import ContractError
from embedmap.operators.voxels import row_hash

#: Bytes of a value by type; 16 for the rest (decimals, intervals).
WIDTHS = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4, "long": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}
MANIFEST = "release string, seq long, name string, n_rows long, n_bytes long, digest string"


# --- rebuild contract -------------------------------------------------------------------------------------------------

def contract_diff(new: DataFrame, old: DataFrame, cols: Sequence[str], key: str = "row_id") -> DataFrame:
    """Per contract column: number of differing rows and the first of them. Rows of only one side differ in every column."""
    tagged = lambda df, p: df.select(F.col(key).alias("_key"), F.lit(True).alias(f"{p}here"), *[F.col(c).alias(f"{p}{c}") for c in cols])
    both = tagged(new, "_a").join(tagged(old, "_b"), "_key", "full")
    alone = F.col("_ahere").isNull() | F.col("_bhere").isNull()
    differs = {c: alone | ~F.col(f"_a{c}").eqNullSafe(F.col(f"_b{c}")) for c in cols}
    one = both.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(d).alias("n_differing"), F.min(F.when(d, F.col("_key"))).alias("first_row")).alias(f"_{i}")
                     for i, (c, d) in enumerate(differs.items())])
    return one.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(differs))])).alias("_d")).select("_d.*")


def check_contract(new: DataFrame, old: DataFrame, cols: Sequence[str], key: str = "row_id") -> None:
    """Refuse a rebuild that changes the row count or a contract column. New columns and wider integers are fine."""
    missing = [c for c in cols if c not in new.columns]
    if missing:
        raise ContractError(f"rebuild lacks contract columns {missing}")
    sizes = (new.count(), old.count())
    if sizes[0] != sizes[1]:
        raise ContractError(f"rebuild has {sizes[0]} rows, the table has {sizes[1]}")
    bad = contract_diff(new, old, cols, key).filter(F.col("n_differing") > 0).collect()  # one row per column
    if bad:
        raise ContractError(f"rebuild changes {[(r['column'], r['n_differing'], r['first_row']) for r in bad]}")


def write_points_table(df: DataFrame, root: str, release: str, contract: Sequence[str], key: str = "row_id") -> Mapping[str, object]:
    """Publish a rebuilt points table; refused, with the old one untouched, when it breaks the contract."""
    spark = df.sparkSession
    previous = current_release(spark, root)

    def validate(tables: Mapping[str, DataFrame]) -> None:
        if previous is not None:
            check_contract(tables["points"], read_release(spark, root, previous)["points"], contract, key)

    return publish_release(lambda: {"points": df}, validate, root, release)


# --- manifests --------------------------------------------------------------------------------------------------------

def value_bytes(df: DataFrame, name: str) -> Column:
    """Bytes of a value: the width of its type, the length of text and binary data, the JSON text of nested values, nothing for null."""
    kind, value = df.schema[name].dataType, df[f"`{name}`"]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        size = F.octet_length(F.to_json(F.struct(value)))
    else:
        size = F.lit(WIDTHS.get(kind.typeName(), 16))
    return F.when(value.isNull(), 0).otherwise(size).cast("long")


def digest(df: DataFrame) -> DataFrame:
    """One row: count, bytes of the values, and an order-free digest of all columns."""
    cols = sorted(df.columns)
    total = sum((value_bytes(df, c) for c in cols), F.lit(0).cast("long"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.sum(row_hash(df.select(*[f"`{c}`" for c in cols]), 0).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"),
    )


def release_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, bytes and digest of every table."""
    out = None
    for name, df in sorted(tables.items()):
        row = digest(df).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("name", "n_rows", "n_bytes", "digest")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole small files (sidecars, exports)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def validate_release(manifest: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tables whose recomputed manifest row differs, is missing or is unknown."""
    again = release_manifest(tables).select("name", *[F.col(c).alias(f"_{c}") for c in ("n_rows", "n_bytes", "digest")])
    joined = manifest.join(again, "name", "full")
    rules = {
        "missing table": F.col("_n_rows").isNull(), "unknown table": F.col("n_rows").isNull(), "rows": F.col("n_rows") != F.col("_n_rows"),
        "bytes": F.col("n_bytes") != F.col("_n_bytes"), "digest": F.col("digest") != F.col("_digest"),
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return joined.select("name", F.explode(flags).alias("problem"))


# --- releases ---------------------------------------------------------------------------------------------------------

def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/*")
    except AnalysisException:
        return None


def releases(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(seq, name) of the published releases, oldest first."""
    found = _manifests(spark, root)
    return [] if found is None else sorted((r["seq"], r["release"]) for r in found.select("seq", "release").distinct().collect())


def current_release(spark: SparkSession, root: str) -> str | None:
    known = releases(spark, root)
    return known[-1][1] if known else None


def read_manifest(spark: SparkSession, root: str, release: str) -> DataFrame:
    return _manifests(spark, root).filter(F.col("release") == release).select("name", "n_rows", "n_bytes", "digest")


def read_release(spark: SparkSession, root: str, release: str) -> dict[str, DataFrame]:
    names = [r["name"] for r in read_manifest(spark, root, release).select("name").collect()]
    if not names:
        raise FileNotFoundError(f"release {release} is not published")
    return {n: spark.read.parquet(f"{root}/releases/{release}/{n}") for n in names}


def publish_release(
    build: Callable[[], Mapping[str, DataFrame]],
    validate: Callable[[Mapping[str, DataFrame]], None],
    root: str,
    release: str,
) -> dict[str, object]:
    """Build into a fresh folder, validate what was written, publish the manifest last. An existing name is refused."""
    tables = dict(build())
    spark = next(iter(tables.values())).sparkSession
    known = releases(spark, root)
    if release in [name for _, name in known]:
        raise FileExistsError(f"release {release} exists; choose a new name")
    for name, df in tables.items():
        # A leftover of a failed attempt is not a release, so it may be replaced.
        df.write.mode("overwrite").parquet(f"{root}/releases/{release}/{name}")
    written = {n: spark.read.parquet(f"{root}/releases/{release}/{n}") for n in tables}
    validate(written)
    seq = known[-1][0] + 1 if known else 0
    manifest = release_manifest(written).select(F.lit(release).alias("release"), F.lit(seq).cast("long").alias("seq"), "name", "n_rows", "n_bytes", "digest")
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifests/{release}")
    return {"release": release, "seq": seq, "tables": sorted(tables)}
