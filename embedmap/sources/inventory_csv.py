"""The inventory as CSV: one line per held row, block fields on the block's first line only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmap.operators.inventory import VOXEL
from embedmap.operators.keys import require_empty
from embedmap.operators.ordering import HOT_ROWS, id_bucket, rank_in_group, small
from embedmap.session import cut
from embedmap.sources.quoted_csv import read_records

# The columns of the format; the legacy header lacks the last one.
COLUMNS = ["version", "dataset", "pack", "chunk_id", "voxel_id", "row_id", "thumbnail_url", "total_points", "repr_row_id",
           "cursor", "returned_row_ids", "first_extracted_at", "last_extracted_at", "selected_row_ids"]
LEGACY_COLUMNS = COLUMNS[:-1]
BLOCK_FIELDS = COLUMNS[7:]


#: Ids of one piece of a cell, put together before the pieces are.
CELL_PIECE = 4096


def _joined(rows: DataFrame, condition, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ids per voxel in seq order as 'a;b;c': the format wants the list in one cell. The tables hold them one per row.

    A crowded voxel's list is made piece by piece in many tasks; only finished pieces of text meet.
    """
    ranked = rank_in_group(rows.filter(condition).select(*VOXEL, "seq", "row_id"), VOXEL, ["seq", "row_id"], "_r", id_bucket("seq"), hot_rows)
    piece = F.call_function("div", F.col("_r"), F.lit(CELL_PIECE).cast("long"))
    text = lambda c: F.concat_ws(";", F.transform(F.array_sort(F.collect_list(c)), lambda e: e["t"]))
    pieces = ranked.groupBy(*VOXEL, piece.alias("_p")).agg(text(F.struct("_r", F.col("row_id").cast("string").alias("t"))).alias("t"))
    return pieces.groupBy(*VOXEL).agg(text(F.struct("_p", "t")).alias(name))


def inventory_to_csv(stacks: DataFrame, rows: DataFrame, urls: DataFrame, dataset: str, pack: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All columns as text, with ``line`` giving the order inside the block. urls: row_id, url.

    The block's fields, whose lists are as long as the block, meet the row of its first line only.
    """
    held = rows.filter(F.col("state") == "held")
    ranked = rank_in_group(held, VOXEL, ["seq", "row_id"], "line", id_bucket("seq"), hot_rows)
    block = (
        stacks.join(_joined(rows, F.col("state") == "returned", "returned_row_ids", hot_rows), VOXEL, "left")
        .join(_joined(rows, F.col("selected"), "selected_row_ids", hot_rows), VOXEL, "left")
        .select(*VOXEL, "total_points", "repr_row_id", "cursor", "returned_row_ids",
                F.col("first_seq").alias("first_extracted_at"), F.col("last_seq").alias("last_extracted_at"), "selected_row_ids")
    )
    head = held.groupBy(*VOXEL).agg(F.min(F.struct("seq", "row_id")).alias("_h")).select(*VOXEL, F.col("_h.row_id").alias("row_id"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    first = lambda c: F.when(F.col("line") == 0, text(c)).otherwise(F.lit("")).alias(c)
    return (
        ranked.join(small(stacks.select(*VOXEL)), VOXEL, "left_semi").join(urls.select("row_id", "url"), "row_id", "left")
        .join(block.join(head, VOXEL), [*VOXEL, "row_id"], "left")
        .select(
            F.lit("1").alias("version"), F.lit(dataset).alias("dataset"), F.lit(pack).alias("pack"), text("chunk_id").alias("chunk_id"),
            text("local_id").alias("voxel_id"), text("row_id").alias("row_id"), text("url").alias("thumbnail_url"),
            *[first(c) for c in BLOCK_FIELDS], F.col("line").cast("long").alias("line"),
        )
    )


def write_inventory_csv(csv: DataFrame, path: str) -> None:
    ordered = csv.withColumns({"_c": F.col("chunk_id").cast("long"), "_v": F.col("voxel_id").cast("long")})
    ordered = ordered.repartitionByRange("_c", "_v", "line").sortWithinPartitions("_c", "_v", "line")
    ordered.select(*COLUMNS).write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"')


def read_inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines as text columns with ``line`` increasing in file order; both header widths are accepted, files with another header are refused.

    A large file is read by many tasks, whatever line ends its quoted cells hold.
    """
    records = cut(read_records(spark, path).filter(F.col("text") != ""))
    headers = records.filter(F.col("number") == 0).select(F.regexp_replace(F.ltrim(F.col("text"), F.lit("\ufeff")), '"', "").alias("h")).distinct().limit(3).collect()
    found = [h[0].split(",") for h in headers]
    if len(found) != 1 or found[0] not in (COLUMNS, LEGACY_COLUMNS):
        raise ValueError("not an inventory CSV")
    names = found[0]
    shape = ", ".join(f"{n} string" for n in names)
    cells = F.from_csv("text", shape, {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"})
    df = records.filter(F.col("number") > 0).select(cells.alias("c"), "line").select("c.*", "line")
    if names == LEGACY_COLUMNS:
        df = df.withColumn("selected_row_ids", F.lit(""))
    return df.na.fill("")


def csv_violations(df: DataFrame) -> DataFrame:
    """Mixed datasets or packs, wrong version, non-numeric ids, and blocks whose fields appear on several lines or none."""
    filled = F.exists(F.array(*[F.col(c) for c in BLOCK_FIELDS]), lambda v: v != "")
    numeric = lambda c: F.col(c).rlike(r"^[0-9]+$")
    ids = numeric("chunk_id") & numeric("voxel_id") & numeric("row_id")
    sources = df.groupBy("dataset", "pack", "version").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("_kinds"), F.count_if(F.col("version") != "1").alias("_bad")
    )
    mixed = sources.filter((F.col("_kinds") > 1) | (F.col("_bad") > 0)).select(
        F.lit("").alias("chunk_id"), F.lit("").alias("voxel_id"), F.lit("mixed datasets").alias("problem"))
    broken = df.filter(~ids).select("chunk_id", "voxel_id", F.lit("invalid integer").alias("problem"))
    per_block = df.groupBy("chunk_id", "voxel_id").agg(F.count_if(filled).alias("_f"), F.min(F.struct("line", filled.alias("f"))).alias("_first"))
    repeated = per_block.filter((F.col("_f") != 1) | ~F.col("_first.f")).select("chunk_id", "voxel_id", F.lit("block metadata").alias("problem"))
    return mixed.unionByName(broken).unionByName(repeated)


def inventory_from_csv(df: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(stacks, rows) from CSV lines; lines with violations are refused. The lines are stored once, as every check and both tables read them."""
    df = cut(df)
    if check:
        require_empty(csv_violations(df), "broken inventory CSV")
    num = lambda c: F.col(c).cast("long")
    head = df.filter(F.col("total_points") != "")
    key = [num("chunk_id").alias("chunk_id"), num("voxel_id").alias("local_id")]
    stacks = head.select(*key, num("cursor").alias("cursor"), num("total_points").alias("total_points"), num("repr_row_id").alias("repr_row_id"),
                         num("first_extracted_at").alias("first_seq"), num("last_extracted_at").alias("last_seq"))
    ids = lambda c: F.filter(F.split(c, ";"), lambda s: s != "").cast("array<long>")
    held = df.select(*key, num("row_id").alias("row_id"), F.lit("held").alias("state"), F.col("line").alias("seq"))
    chosen = head.select(*key, F.explode(ids("selected_row_ids")).alias("row_id"), F.lit(True).alias("selected"))
    back = head.select(*key, F.posexplode(ids("returned_row_ids")).alias("seq", "row_id")).select(
        *VOXEL, "row_id", F.lit("returned").alias("state"), F.lit(False).alias("selected"),
        F.col("seq").cast("long").alias("seq"))
    held = held.join(chosen, [*VOXEL, "row_id"], "left").na.fill(False, ["selected"])
    return stacks, held.select(*back.columns).unionByName(back)
