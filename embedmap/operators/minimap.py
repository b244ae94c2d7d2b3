"""2-D density pyramid, tiled points, level-of-detail selection and spatial pages over quantised coordinates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embedmap.functions import codec, grid
from embedmap.operators import discs, gridsearch
from embedmap.operators.keys import refusing_join
from embedmap.operators.ordering import (
    HOT_ROWS, id_bucket, limit_per_group, md5_bucket, md5_priority, position_in_order, rank_in_group, union_all,
)
from embedmap.session import cut

RECORD_BYTES = 8          # fixed: x, y and packed id of a stored point
LOD_RECORD_BYTES = 9      # fixed: the same plus the minimum zoom
PAGE_ROWS = 4096
OVERVIEW_SHIFT = 7        # 512 x 512 bins


# --- density ----------------------------------------------------------------------------------------------------------

def density_finest(q: DataFrame, zoom: int) -> DataFrame:
    """Points per corpus and bin at the given zoom, sparse: corpus, bin_x, bin_y, n. ``q``: qx, qy, corpus."""
    return q.groupBy("corpus", grid.bins_at(F.col("qx"), zoom).alias("bin_x"), grid.bins_at(F.col("qy"), zoom).alias("bin_y")).agg(
        F.count(F.lit(1)).alias("n")
    )


def density_pyramid(finest: DataFrame, zoom: int) -> DataFrame:
    """2x2 sums from ``zoom`` down to 0: z, corpus, bin_x, bin_y, n. The levels are exploded after the counting."""
    levels = finest.withColumn("z", F.explode(F.array(*[F.lit(z) for z in range(zoom + 1)])))
    down = lambda c: F.expr(f"shiftright({c}, {zoom} - z)")
    return (
        levels.select(F.col("z").cast("long").alias("z"), "corpus", down("bin_x").alias("bin_x"), down("bin_y").alias("bin_y"), "n")
        .groupBy("z", "corpus", "bin_x", "bin_y").agg(F.sum("n").alias("n"))
    )


def tile_index(pyramid: DataFrame) -> DataFrame:
    """Per level and occupied tile: count and corpora present (at most 16, ascending)."""
    return (
        pyramid.groupBy("z", F.shiftright("bin_y", 8).alias("ty"), F.shiftright("bin_x", 8).alias("tx"), "corpus")
        .agg(F.sum("n").alias("n"))
        .groupBy("z", "ty", "tx")
        .agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("corpus")).alias("corpora"))
    )


def level_index(pyramid: DataFrame) -> DataFrame:
    """Per level: tiles and planes written, total count and the log of the fullest combined bin."""
    combined = pyramid.groupBy("z", "bin_y", "bin_x").agg(F.sum("n").alias("n"))
    peaks = combined.groupBy("z").agg(F.log1p(F.max("n").cast("double")).alias("log_peak"), F.sum("n").alias("total"))
    tiles = tile_index(pyramid).groupBy("z").agg(
        F.count(F.lit(1)).alias("tiles_written"), F.sum(F.size("corpora")).alias("planes_written")
    )
    return peaks.join(tiles, "z")


def overview_density(q: DataFrame) -> DataFrame:
    """All points in 512 x 512 bins."""
    return q.groupBy(F.shiftright("qx", OVERVIEW_SHIFT).alias("bin_x"), F.shiftright("qy", OVERVIEW_SHIFT).alias("bin_y")).agg(
        F.count(F.lit(1)).alias("n")
    )


def overview_stats(counts: DataFrame, n: int) -> DataFrame:
    return counts.agg(
        F.count(F.lit(1)).alias("occupied_bins"), F.max("n").alias("max_bin"), F.sum("n").alias("total"),
        (F.sum("n") == F.lit(n)).alias("conserved"),
    )


def corpus_counts(q: DataFrame, mapping: Mapping[str, int]) -> DataFrame:
    """Count of every mapped corpus, zero included."""
    names = q.sparkSession.createDataFrame([(k, int(v)) for k, v in mapping.items()], "name string, corpus long")
    counted = q.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "corpus", "left").na.fill(0, ["n"])


# --- tiled points -----------------------------------------------------------------------------------------------------

def with_tile(q: DataFrame, zoom: int) -> DataFrame:
    bx, by = grid.bins_at(F.col("qx"), zoom), grid.bins_at(F.col("qy"), zoom)
    return q.withColumns({"tile": grid.tile_of(bx, by, zoom), "morton": grid.morton(bx, by)})


def points_tiled(q: DataFrame, zoom: int, hot_rows: int = HOT_ROWS, split_bits: int = 20) -> DataFrame:
    """Point records in (tile, Morton, row_id) order with their global position.

    Positions come from cell counts, so there is no global sort and a crowded cell is split by row id.
    """
    tiled = with_tile(q, zoom)
    out = position_in_order(tiled, ["tile"], ["morton"], "row_id", "pos", id_bucket("row_id", split_bits), hot_rows)
    return out.select("pos", "tile", "qx", "qy", "corpus", "row_id")


def packed_points(tiled: DataFrame) -> DataFrame:
    """Records with corpus and row id in one 32-bit field; ids that do not fit stop the job."""
    return tiled.select("pos", "tile", "qx", "qy", codec.pack_point(F.col("corpus"), F.col("row_id")).alias("packed"))


def write_points_tiled(points: DataFrame, path: str) -> None:
    """Stored in position order, so that row groups cover compact tiles."""
    points.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("errorifexists").parquet(path)


def tile_offsets(q: DataFrame, zoom: int) -> DataFrame:
    """Byte offset of every tile, empty ones and the end included (at most 4^5 + 1 rows in the window)."""
    tiles = with_tile(q, zoom).groupBy("tile").agg(F.count(F.lit(1)).alias("_n"))
    slots = q.sparkSession.range(4**zoom + 1).withColumnRenamed("id", "tile")
    w = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce("_n", F.lit(0))).over(w), F.lit(0))
    return slots.join(tiles, "tile", "left").select("tile", (before * RECORD_BYTES).cast("long").alias("byte_offset"))


# --- level of detail --------------------------------------------------------------------------------------------------

def rank_within(df: DataFrame, group: list[str], priority: str, id_col: str = "row_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank inside each group by an md5 priority; hot groups are split by the leading digits."""
    return rank_in_group(df, group, [priority, id_col], "rank", md5_bucket(priority), hot_rows)


def cap_for_budget(counts: DataFrame, budget: Column, n_col: str = "n") -> DataFrame:
    """One row ``cap``: the largest c with sum(min(n, c)) <= budget, at least 1.

    Works on the histogram of the counts (at most about sqrt(2N) distinct values): between two neighbouring counts the
    sum is linear in c, so every interval has a closed-form best c.
    """
    hist = counts.groupBy(F.col(n_col).alias("v")).agg(F.count(F.lit(1)).alias("f"))
    w = Window.orderBy("v")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = hist.select(
        "v",
        F.coalesce(F.lag("v").over(w), F.lit(0)).alias("start"),
        F.coalesce(F.sum(F.col("v") * F.col("f")).over(below), F.lit(0)).alias("settled"),
        (F.sum("f").over(whole) - F.coalesce(F.sum("f").over(below), F.lit(0))).alias("open"),
        budget.alias("_budget"),
    )
    # For c in (start, v]: sum = settled + c * open.
    best = F.least(F.col("v"), F.floor((F.col("_budget") - F.col("settled")) / F.col("open")).cast("long"))
    valid = F.when(best > F.col("start"), best)
    return steps.agg(F.greatest(F.coalesce(F.max(valid), F.lit(1)), F.lit(1)).cast("long").alias("cap"))


def lod_budget(n: int, limit: int) -> int:
    budget = min(n // 4, limit)
    return budget if budget >= 1 else n


def _bin_cols(zoom: int) -> dict[str, Column]:
    return {"bin_x": grid.bins_at(F.col("qx"), zoom), "bin_y": grid.bins_at(F.col("qy"), zoom)}


def lod_select(q: DataFrame, zoom: int, seed: int, n: int, limit: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Density-stratified sample within the budget: row_id, qx, qy, corpus, prio.

    The stratum zoom is the finest whose occupied bins fit the budget; each bin keeps the ``cap`` first rows by priority;
    what exceeds the budget is trimmed by (rank, priority).
    """
    budget = lod_budget(n, limit)
    levels = cut(density_pyramid(density_finest(q.withColumn("corpus", F.lit(0).cast("long")), zoom), zoom))
    occupied = {r["z"]: r["bins"] for r in levels.groupBy("z").agg(F.count(F.lit(1)).alias("bins")).collect()}
    stratum = max((z for z in range(zoom + 1) if occupied.get(z, 0) <= budget), default=0)
    cap = cap_for_budget(levels.filter(F.col("z") == stratum), F.lit(budget)).first()["cap"]
    ranked = rank_within(
        q.withColumn("prio", md5_priority(seed, "row_id")).withColumns(_bin_cols(stratum)), ["bin_x", "bin_y"], "prio", hot_rows=hot_rows
    ).filter(F.col("rank") < cap)
    if occupied.get(stratum, 0) > budget:
        # Only zoom 0 can exceed the budget: at most 256 x 256 bins with one row each are left to trim.
        ranked = ranked.orderBy("rank", "prio", "row_id").limit(budget)
    return ranked.drop("bin_x", "bin_y", "rank")


def lod_min_zoom(selected: DataFrame, zoom: int, budget: int) -> DataFrame:
    """First zoom at which each selected point is shown. ``selected`` has at most ``budget`` rows (2 million).

    At zoom z the target is budget / 4^(zoom - z); the cap never falls below the cap of the previous zoom. The selection
    is written once, because every zoom counts it again.
    """
    selected = cut(selected)
    caps, previous = [], 0
    for z in range(zoom):
        counts = selected.groupBy(*[c.alias(k) for k, c in _bin_cols(z).items()]).agg(F.count(F.lit(1)).alias("n"))
        caps.append(cap_for_budget(counts, F.lit(max(1, budget // 4 ** (zoom - z)))).select(F.lit(z).alias("z"), "cap"))
    raw = {r["z"]: r["cap"] for r in union_all(caps).collect()} if caps else {}
    visible = []
    out = selected
    for z in range(zoom):
        previous = max(previous, raw[z])
        w = Window.partitionBy(*[grid.bins_at(F.col(c), z) for c in ("qy", "qx")]).orderBy("prio", "row_id")
        out = out.withColumn(f"_r{z}", F.row_number().over(w) - 1)
        visible.append(F.when(F.col(f"_r{z}") < previous, F.lit(z)))
    first = F.coalesce(F.least(*visible, F.lit(zoom)), F.lit(zoom)) if visible else F.lit(zoom)
    return out.withColumn("min_zoom", first.cast("long")).drop(*[f"_r{z}" for z in range(zoom)])


def lod_offsets(with_zoom: DataFrame, zoom: int) -> DataFrame:
    """Points and starting byte of every minimum zoom, the end included."""
    counts = with_zoom.groupBy("min_zoom").agg(F.count(F.lit(1)).alias("n"))
    slots = with_zoom.sparkSession.range(zoom + 2).withColumnRenamed("id", "min_zoom")
    w = Window.orderBy("min_zoom").rowsBetween(Window.unboundedPreceding, -1)
    filled = slots.join(counts, "min_zoom", "left").na.fill(0, ["n"])
    return filled.withColumn("byte_offset", (F.coalesce(F.sum("n").over(w), F.lit(0)) * LOD_RECORD_BYTES).cast("long"))


# --- spatial rows -----------------------------------------------------------------------------------------------------

def spatial_rows(tiled: DataFrame, row_to_voxel: DataFrame) -> DataFrame:
    """Position, 2-D coordinates, corpus and voxel address of every row."""
    placed = tiled.select("pos", "qx", "qy", "row_id", "corpus")
    return refusing_join(placed, row_to_voxel.select("row_id", "chunk_id", "local_id"), ["row_id"], "row without a voxel")


def row_xy(rows: DataFrame) -> DataFrame:
    """Inverse lookup: coordinates by row."""
    return rows.select("row_id", "qx", "qy")


def spatial_pages(rows: DataFrame, size: int = PAGE_ROWS) -> DataFrame:
    """Bounding box and size of every ``size`` rows in tile order."""
    page = F.call_function("div", F.col("pos"), F.lit(size).cast("long"))
    return rows.groupBy(page.alias("page")).agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"), F.min("qx").alias("x0"), F.min("qy").alias("y0"),
        F.max("qx").alias("x1"), F.max("qy").alias("y1"),
    )


#: Bits of the cells' side in a nearest search: the largest cells, and the smallest that many positions lead to.
MOST_BITS, LEAST_BITS = 8, 2
#: Cells per radius and axis in a search of all rows within it.
RADIUS_CELLS = 4


def nearest_rows(rows: DataFrame, queries: DataFrame, cell_bits: int | None = None) -> DataFrame:
    """Nearest row (lowest row_id on ties) of each query position in quantised units. ``queries``: q, qx, qy.

    Rows at one position are one candidate, so a cell holds as many as it has positions, however many rows there are. The cells
    get smaller as the positions become more, so that a query meets as many in a large table as in a small one.
    """
    spots = rows.groupBy("qx", "qy").agg(F.min("row_id").alias("row_id"))
    if cell_bits is None:
        spots = cut(spots)
        cell_bits = gridsearch.cell_bits_for(spots.count(), 2, 16, LEAST_BITS, MOST_BITS)
    return gridsearch.nearest(spots, queries, ["qx", "qy"], ["qx", "qy"], "q", ["row_id"], 16, cell_bits)


def rows_in_radius(rows: DataFrame, queries: DataFrame, radius: float, cap: int | None = None) -> DataFrame:
    """Rows within ``radius`` quantised units of each query: q, row_id, d2; optionally the ``cap`` nearest.

    With a cap the pairs are not listed: of the rows at one position the first ``cap`` can count, and tasks keep ``cap`` rows per query.
    """
    if cap is not None:
        spots = limit_per_group(rows.select("row_id", "qx", "qy"), ["qx", "qy"], ["row_id"], cap, "_at")
        hits = discs.fold(spots, ["row_id"], queries, radius, lambda ids: discs.Nearest(ids, float(radius) ** 2, cap), discs.Nearest.SCHEMA)
        return limit_per_group(hits, ["q"], ["d2", "row_id"], cap).drop("rank")
    hits = gridsearch.within(rows.select("row_id", "qx", "qy"), queries, ["qx", "qy"], ["qx", "qy"], "q", radius, fine=RADIUS_CELLS)
    return hits.select("q", "row_id", "d2")


def voxels_in_radius(rows: DataFrame, queries: DataFrame, radius: float, max_voxels: int | None = None) -> DataFrame:
    """Voxels of the rows within the radius with their row counts, the fullest first; only the first ``max_voxels`` per query if asked for."""
    # Rows at one position in one voxel meet a query together, so the search sees positions, not rows.
    spots = rows.groupBy("qx", "qy", "chunk_id", "local_id").agg(F.count(F.lit(1)).alias("n"))
    # Tasks count per query and voxel, so that no pair of query and position leaves them.
    sums = discs.fold(spots, ["chunk_id", "local_id", "n"], queries, radius, lambda ids: discs.Counts(ids, float(radius) ** 2), discs.Counts.SCHEMA)
    counted = sums.groupBy("q", F.col("a").alias("chunk_id"), F.col("b").alias("local_id")).agg(F.sum("n").alias("n"))
    if max_voxels is None:  # all of them: a query with very many is ranked in buckets of the count
        ranked = rank_in_group(cut(counted), ["q"], [F.desc("n"), "chunk_id", "local_id"], "rank", -F.col("n"))
        return ranked.withColumn("rank", F.col("rank") + 1)
    return limit_per_group(counted, ["q"], [F.desc("n"), "chunk_id", "local_id"], max_voxels)


def validate_minimap(q: DataFrame, pyramid: DataFrame, offsets: DataFrame, n: int) -> DataFrame:
    """One row per check with expected and actual number; ``ok`` must hold everywhere."""
    check = lambda df, name: df.select(F.concat(F.lit(name), F.col("k")).alias("name"), F.col("v").cast("long").alias("actual"))
    parts = check(q.agg(F.lit("").alias("k"), F.count(F.lit(1)).alias("v")), "points").unionByName(
        check(offsets.agg(F.lit("").alias("k"), (F.max("byte_offset") / RECORD_BYTES).alias("v")), "offsets end")
    ).unionByName(
        check(pyramid.groupBy(F.col("z").cast("string").alias("k")).agg(F.sum("n").alias("v")), "level ")
    )
    return parts.withColumn("expected", F.lit(n).cast("long")).withColumn("ok", F.col("actual") == F.col("expected"))
