"""Image facts, conjunctive metadata filters, row masks and filtered roll-ups."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.functions import grid
from embedmap.operators import lod
from embedmap.operators.keys import duplicate_keys, refusing_join, require_empty

# Fixed values of the filter language.
YEAR_MAX = 2100
LABELS = (("Book ID", "book"), ("Author", "author"), ("Publication year (recorded)", "year"), ("Publisher", "publisher"),
          ("Place", "place"), ("Volume", "volume"), ("Page", "page"), ("Image type", "subset"))


def build_images(points: DataFrame, postings: DataFrame, source: DataFrame, check: bool = True) -> DataFrame:
    """Image fact: book from the nine leading digits of the file name, year only when exactly four digits, voxel address,
    position in the voxel, and the optional source record.

    points: row_id, subset, local_idx, fname, date; source: fname, subset, volume, page (unique key).
    """
    if check:
        require_empty(duplicate_keys(source, ["fname", "subset"]), "source key is not unique")
    book = F.regexp_extract("fname", r"^(\d{9})_", 1)
    missing = F.raise_error(F.concat(F.lit("missing book identity: "), F.col("fname")))
    year = F.when(F.col("date").rlike(r"^\d{4}$"), F.col("date")).try_cast("int")
    facts = points.withColumn("book", F.when(book == "", missing.cast("string")).otherwise(book)).withColumn("year", year)
    return (
        refusing_join(facts, postings.select("row_id", "chunk_id", "local_id", "pos"), ["row_id"], "image without a posting")
        .join(source, ["fname", "subset"], "left")
        .select("row_id", "subset", "local_idx", "book", "year", "chunk_id", "local_id", "pos", "fname", "volume", "page")
    )


@dataclass(frozen=True)
class Rule:
    """One key of a filter: what its value may be, and the condition that the value stands for (None for a mere option)."""

    allowed: Callable[[object], bool]
    expects: str
    condition: Callable[[object], Column] | None = None
    dated: bool = False


def _is_year(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v in range(YEAR_MAX + 1)


def _rules(types: Collection[str]) -> dict[str, Rule]:
    col = F.col
    return {
        "type": Rule(lambda v: v in ("", None) or v in types, f"one of {sorted(types)}", lambda v: col("subset") == v),
        "minYear": Rule(lambda v: v is None or _is_year(v), f"a year of 0..{YEAR_MAX}", lambda v: col("year") >= v, dated=True),
        "maxYear": Rule(lambda v: v is None or _is_year(v), f"a year of 0..{YEAR_MAX}", lambda v: col("year") <= v, dated=True),
        "includeUnknown": Rule(lambda v: isinstance(v, bool), "true or false"),
        "book": Rule(lambda v: v in ("", None) or (isinstance(v, str) and re.fullmatch(r"\d{9}", v) is not None), "nine digits", lambda v: col("book") == v),
    }


def metadata_predicate(value: Mapping[str, object], types: Collection[str]) -> Column:
    """The rows that satisfy every key of ``value``; ValueError if a key or its value isn't part of the filter language.

    With ``includeUnknown`` the conditions on years also accept rows without one.
    """
    rules = _rules(types)
    given = dict(value) if isinstance(value, Mapping) else {"": None}
    for key, v in given.items():
        if key not in rules:
            raise ValueError(f"no filter key {key!r}")
        if not rules[key].allowed(v):
            raise ValueError(f"filter key {key} takes {rules[key].expects}")
    if None not in (span := (given.get("minYear"), given.get("maxYear"))) and span[0] > span[1]:
        raise ValueError(f"no year lies in {span[0]}..{span[1]}")
    also = F.col("year").isNull() if given.get("includeUnknown") else F.lit(False)
    active = [(rules[k], v) for k, v in given.items() if rules[k].condition and v not in ("", None)]
    return reduce(lambda a, b: a & b, [r.condition(v) | also if r.dated else r.condition(v) for r, v in active], F.lit(True))


def filter_rows(images: DataFrame, value: Mapping[str, object], types: Collection[str]) -> DataFrame:
    return images.filter(metadata_predicate(value, types))


def filter_counts(matching: DataFrame) -> DataFrame:
    """Matching rows per voxel."""
    return matching.groupBy("chunk_id", "local_id").agg(F.count(F.lit(1)).alias("n"))


def row_mask(matching: DataFrame) -> DataFrame:
    """One bit per row, lowest bit first, in buckets of 4,096 bytes (32,768 rows): bucket 0, 1, ... and mask."""
    row = F.col("row_id") + 1  # the built-in positions count from one
    return matching.groupBy((F.bitmap_bucket_number(row) - 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("mask")
    )


def mask_rows(mask: DataFrame) -> DataFrame:
    """Row ids of the set bits."""
    byte = mask.select("bucket", F.posexplode(F.expr("transform(sequence(1, octet_length(mask)), i -> cast(conv(hex(substring(mask, i, 1)), 16, 10) as int))")).alias("i", "v"))
    bits = byte.filter(F.col("v") > 0).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return bits.filter(F.expr("shiftright(v, bit) % 2 = 1")).select(
        (F.col("bucket") * 32768 + F.col("i") * 8 + F.col("bit")).alias("row_id")
    )


def filter_schema(images: DataFrame) -> DataFrame:
    """Bounds of the recorded year and the categories."""
    return images.agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.array_sort(F.collect_set("subset")).alias("options"))


def image_detail(images: DataFrame, books: DataFrame, rows: DataFrame) -> DataFrame:
    """Title (file name when the catalogue has none) and provenance of the wanted rows, with all book columns.

    A wanted row that isn't an image stops the job.
    """
    joined = refusing_join(rows.select("row_id").distinct(), images, ["row_id"], "unknown row").join(
        books.select(F.col("id").alias("book"), F.nullif("title", F.lit("")).alias("_title"), "author", "publisher", "place"), "book", "left"
    )
    return joined.withColumn("title", F.coalesce("_title", "fname")).withColumn(
        "provenance", F.when(F.col("_title").isNotNull(), "catalog title").otherwise("source filename")
    ).drop("_title")


def image_links(detail: DataFrame, row_url: Column, links: DataFrame) -> DataFrame:
    """Links of every detail row in display order: its source row, and its photo page where the source has one.

    ``row_url`` makes the address of the source row from the detail's columns; links: fname, subset, photo_url (unique key).
    """
    joined = detail.join(links.select("fname", "subset", "photo_url"), ["fname", "subset"], "left")
    each = F.array(F.struct(F.lit("source row").alias("label"), row_url.alias("url")), F.struct(F.lit("photo page").alias("label"), F.nullif("photo_url", F.lit("")).alias("url")))
    return joined.select("row_id", F.posexplode(each).alias("seq", "_l")).select("row_id", "seq", "_l.*").filter(F.col("url").isNotNull())


def image_fields(detail: DataFrame) -> DataFrame:
    """The non-empty labelled fields of each detail row, in display order: row_id, seq, label, value."""
    pairs = F.array(*[F.struct(F.lit(l).alias("label"), F.col(c).cast("string").alias("value")) for l, c in LABELS])
    long = detail.select("row_id", F.posexplode(pairs).alias("seq", "_f")).select("row_id", "seq", "_f.*")
    return long.filter(F.col("value").isNotNull() & (F.col("value") != ""))


def _ascii_lower(c: Column) -> Column:
    upper = "".join(chr(65 + i) for i in range(26))
    return F.translate(c, upper, upper.lower())


def find_books(books: DataFrame, images: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Books with images whose id equals a nine-digit query, else whose title contains it (ASCII case ignored).

    With ``limit``, the first so many by title.
    """
    text = text.strip()
    none = books.select("id", "title").limit(0)
    if not 2 <= len(text) <= 120:
        return none
    used = images.select(F.col("book").alias("id"))
    if re.fullmatch(r"[0-9]{9}", text):
        named = used.filter(F.col("id") == text).limit(1).join(books.select("id", "title"), "id", "left")
        return named.select("id", F.coalesce("title", "id").alias("title"))
    hit = F.contains(_ascii_lower(F.col("title")), _ascii_lower(F.lit(text)))
    found = books.select("id", "title").filter(hit).join(used, "id", "left_semi")
    return found if limit is None else found.orderBy("title", "id").limit(limit)


def filtered_cells(counts: DataFrame, vpc: int, step: int) -> DataFrame:
    """Per coarse cell: total, largest count and the first local id that has it."""
    best = F.min(F.struct((-F.col("n")).alias("_neg"), F.col("local_id")))
    return lod.with_cells(counts, vpc, [step]).groupBy(*lod.CELL).agg(
        F.sum("n").alias("total"), F.max("n").alias("max_n"), best.alias("_best")
    ).withColumn("best_local", F.col("_best.local_id")).drop("_best")


def filtered_octree(counts: DataFrame, chunks_per_axis: int) -> DataFrame:
    """Filtered totals of every octree node; level 0 are the chunks."""
    axes = dict(zip(("cx", "cy", "cz"), grid.axes_of(F.col("chunk_id"), chunks_per_axis)))
    totals = counts.groupBy("chunk_id").agg(F.sum("n").alias("n_points")).withColumns(axes)
    return lod.octree(totals, chunks_per_axis)


@dataclass(frozen=True)
class MapIdentity:
    """What an artifact must have been built for: digest and row count of the map's points, as in its manifest."""

    digest: str
    rows: int


def identity_of(manifest: DataFrame, name: str = "points") -> MapIdentity:
    row = manifest.filter(F.col("name") == name).select("digest", "n_rows").first()
    if row is None:
        raise ValueError(f"the manifest has no table {name}")
    return MapIdentity(row["digest"], row["n_rows"])


_BOUND = ("map_digest", "map_rows")


def bind(artifact: DataFrame, identity: MapIdentity) -> DataFrame:
    """A mask, count table or index with the identity of its map in every row, so that it travels with the data."""
    return artifact.withColumns({"map_digest": F.lit(identity.digest), "map_rows": F.lit(identity.rows).cast("long")})


def belongs(identity: MapIdentity) -> Column:
    return F.col("map_digest").eqNullSafe(F.lit(identity.digest)) & F.col("map_rows").eqNullSafe(F.lit(identity.rows).cast("long"))


def bound(artifact: DataFrame, identity: MapIdentity) -> DataFrame:
    """The artifact without its identity; a row of another map, or an artifact that was never bound, is refused when it is read."""
    if not set(_BOUND) <= set(artifact.columns):
        raise ValueError("artifact without an identity")
    refused = F.raise_error(F.concat(F.lit("artifact belongs to another map: "), F.coalesce("map_digest", F.lit("none")))).cast("boolean")
    return artifact.filter(F.when(belongs(identity), F.lit(True)).otherwise(refused)).drop(*_BOUND)


def foreign_rows(artifacts: Mapping[str, DataFrame], identity: MapIdentity) -> DataFrame:
    """Rows of every bound artifact, and those that belong to another map: artifact, n_rows, n_foreign."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~belongs(identity)).alias("n_foreign")).select(F.lit(name).alias("artifact"), "n_rows", "n_foreign")
             for name, df in sorted(artifacts.items())]
    return reduce(DataFrame.unionByName, parts)


def check_snapshot(mask: DataFrame, counts: DataFrame, n: int, chunks: int, vpc: int, identity: MapIdentity | None = None) -> DataFrame:
    """One row: bits set, sum of counts, repeated voxels, addresses out of bounds, and whether all agree.

    With an ``identity``, mask and counts must be bound to it.
    """
    if identity is not None:
        mask, counts = bound(mask, identity), bound(counts, identity)
    bits = mask.agg(F.coalesce(F.sum(F.bitmap_count("mask")), F.lit(0)).cast("long").alias("bits"), F.lit(0).alias("_k"))
    inside = F.col("chunk_id").between(0, chunks - 1) & F.col("local_id").between(0, vpc**3 - 1) & (F.col("n") > 0)
    per_voxel = counts.groupBy("chunk_id", "local_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_c"))
    sums = per_voxel.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count_if(F.col("_c") > 1).alias("repeated"),
        F.count_if(~inside).alias("outside"), F.lit(0).alias("_k"),
    )
    ok = (F.col("bits") == F.col("total")) & (F.col("bits") <= n) & (F.col("repeated") == 0) & (F.col("outside") == 0)
    return bits.join(sums, "_k").drop("_k").withColumn("ok", ok)


def check_identity(mine: Mapping[str, object], theirs: Mapping[str, object]) -> None:
    """Refuse an artifact built for another map: digest and row count must both be equal."""
    if (mine.get("digest"), mine.get("rows")) != (theirs.get("digest"), theirs.get("rows")):
        raise ValueError("artifact belongs to another map")
