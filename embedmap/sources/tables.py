"""Readers of source tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MAX_SIDE = 65535


def read_points(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """The named columns only; a missing one is an error before anything is read."""
    df = spark.read.parquet(path)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"points table lacks {missing}")
    return df.select(*cols)


def read_manifest_set(spark: SparkSession, paths: Mapping[str, str], cols: Sequence[str] | None = None) -> DataFrame:
    """One table per subset, concatenated with its subset name and source file; an empty subset is an error."""
    out = None
    for subset, path in sorted(paths.items()):
        try:
            df = spark.read.parquet(path)
        except AnalysisException as error:
            raise FileNotFoundError(f"subset {subset} has no files at {path}") from error
        if df.isEmpty():
            raise FileNotFoundError(f"subset {subset} has no rows at {path}")
        df = df.select(*(cols or df.columns), F.col("_metadata.file_path").alias("source_file")).withColumn("subset", F.lit(subset))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no subsets given")
    return out


# The columns of the catalogue files.
CATALOG_COLUMNS = ("book_identifier", "title", "first_author", "publisher", "pubplace", "ARK_id_of_book")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return raw.select(F.col(CATALOG_COLUMNS[0]).alias("id"), F.col("title"), F.col("first_author").alias("author"), "publisher",
                      F.col("pubplace").alias("place"), F.col("ARK_id_of_book").alias("ark"))


def _padded_id() -> Column:
    return F.when(F.length("id") < 9, F.lpad("id", 9, "0")).otherwise(F.col("id"))


def build_catalog(rows: DataFrame, conflicts: str = "refuse") -> DataFrame:
    """One book per zero-padded id, the smallest of several rows, since rows of files have no order here.

    Rows of one id with different titles are refused when the catalogue is read; ``conflicts="smallest"`` takes the smallest of those too.
    ``catalog_conflicts`` lists them.
    """
    if conflicts not in ("refuse", "smallest"):
        raise ValueError(f"unknown rule {conflicts}")
    fields = [c for c in rows.columns if c != "id"]
    one = rows.withColumn("id", _padded_id()).groupBy("id").agg(
        F.min(F.struct(*fields)).alias("_b"), *[f(F.coalesce("title", F.lit(""))).alias(n) for n, f in (("_first", F.min), ("_last", F.max))])
    if conflicts == "refuse":
        refused = F.raise_error(F.concat(F.lit("conflicting titles of book "), F.coalesce("id", F.lit("null")))).cast("string")
        one = one.withColumn("id", F.when(F.col("_first") == F.col("_last"), F.col("id")).otherwise(refused))
    return one.select("id", "_b.*")


def catalog_conflicts(rows: DataFrame) -> DataFrame:
    """Ids with more than one title; the catalogue is refused when there are any."""
    first, last = F.min("title").alias("first_title"), F.max("title").alias("last_title")
    return rows.withColumn("id", _padded_id()).groupBy("id").agg(first, last).filter(~F.col("first_title").eqNullSafe(F.col("last_title")))


def harvest_columns(df: DataFrame) -> DataFrame:
    """url, width, height of a shard whose columns may be missing: empty url is null, bad sizes are 0, sides are clipped."""
    def side(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0).cast("long")
        v = F.col(name).cast("double")
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        return F.when(bad, 0).otherwise(F.least(F.greatest(F.floor(F.least(v, F.lit(1e9))), F.lit(0)), F.lit(MAX_SIDE))).cast("long")

    url = F.nullif(F.col("url").cast("string"), F.lit("")) if "url" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"url": url, "width": side("width"), "height": side("height")})
