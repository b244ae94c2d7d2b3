"""Selection bookkeeping per voxel: what is held, what was returned, what comes next.

State is kept as two tables. Rows: chunk_id, local_id, row_id, state ('held' or 'returned'), selected, seq. Stacks (one
row per touched voxel): chunk_id, local_id, cursor, first_seq, last_seq. Lists are never gathered per voxel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.operators.ordering import HOT_ROWS, id_bucket, limit_per_group, running_total, small
from embedmap.session import cut

VOXEL = ["chunk_id", "local_id"]
HAND_BATCH, PICKAXE_BATCH = 1, 100  # fixed: rows taken per extraction
ROWS_PER_PAGE = 60                  # fixed: rows shown per inventory page


def replay(events: DataFrame, hot_rows: int = HOT_ROWS, split_bits: int = 20) -> DataFrame:
    """Events after the last reset of their voxel. A voxel resets when its running number of held rows reaches zero.

    events: chunk_id, local_id, row_id, pos, op ('extract' or 'return'), seq (unique in the voxel), cursor_after.
    """
    step = F.when(F.col("op") == "extract", 1).otherwise(-1).cast("long")
    totals = running_total(events, VOXEL, ["seq"], step, "_held_before", id_bucket("seq", split_bits), hot_rows)
    resets = totals.filter(F.col("_held_before") + step == 0).groupBy(*VOXEL).agg(F.max("seq").alias("_reset"))
    return events.join(resets, VOXEL, "left").filter(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset")


def stacks_of(live: DataFrame) -> DataFrame:
    """Cursor and first/last extraction of every touched voxel, from ``replay`` output."""
    taken = F.when(F.col("op") == "extract", F.col("seq"))
    return live.groupBy(*VOXEL).agg(
        F.max("cursor_after").alias("cursor"), F.min(taken).alias("first_seq"), F.max(taken).alias("last_seq")
    )


def rows_of(live: DataFrame, stacks: DataFrame) -> DataFrame:
    """Held and returned rows. A held row at or past the cursor is selected; a returned row past it leaves no trace."""
    last = live.groupBy(*VOXEL, "row_id").agg(F.max(F.struct("seq", "op", "pos")).alias("_l"))
    rows = last.select(*VOXEL, "row_id", F.col("_l.seq").alias("seq"), F.col("_l.op").alias("op"), F.col("_l.pos").alias("pos"))
    held = F.col("op") == "extract"
    return (
        rows.join(stacks.select(*VOXEL, "cursor"), VOXEL)
        .filter(held | (F.col("pos") < F.col("cursor")))
        .select(*VOXEL, "row_id", F.when(held, "held").otherwise("returned").alias("state"),
                (held & (F.col("pos") >= F.col("cursor"))).alias("selected"), "seq")
    )


def _take(candidates: DataFrame, batch: int) -> DataFrame:
    """First rows per voxel by (class, order). The limit is applied before the shuffle."""
    return limit_per_group(candidates, VOXEL, ["cls", "ord", "row_id"], batch, "take").select(*VOXEL, "row_id", "take")


def batch_bounds(rows: DataFrame, stacks: DataFrame, batch: int) -> DataFrame:
    """Positions [low, high) of every touched voxel that hold its next ``batch`` rows: selected rows in the way move the end up."""
    skipped = rows.filter("selected").groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("skipped"))
    high = F.col("cursor") + batch + F.coalesce("skipped", F.lit(0))
    return stacks.select(*VOXEL, "cursor").join(skipped, VOXEL, "left").select(*VOXEL, F.col("cursor").alias("low"), high.alias("high"))


def next_batch(postings: DataFrame, rows: DataFrame, stacks: DataFrame, batch: int = PICKAXE_BATCH) -> DataFrame:
    """Next rows of every voxel: the return queue first, then postings from the cursor on, selected rows skipped.

    Postings are cut to the positions that can be taken before anything is shuffled: by the furthest end of all voxels in the
    scan, and by each voxel's own bounds through a join with the touched voxels, broadcast while they are few.
    """
    queue = rows.filter(F.col("state") == "returned").select(*VOXEL, "row_id", F.lit(0).alias("cls"), F.col("seq").alias("ord"))
    bounds = cut(batch_bounds(rows, stacks, batch))
    reach = bounds.agg(F.max("high")).first()[0] or 0
    near = postings.filter(F.col("pos") < F.lit(max(reach, batch))).join(small(bounds), VOXEL, "left")
    near = near.filter((F.col("pos") >= F.coalesce("low", F.lit(0))) & (F.col("pos") < F.coalesce("high", F.lit(batch))))
    # A selected row is known with its voxel: the voxel in the key lets the join keep what the first one shuffled, and
    # the row in the key spreads a crowded voxel.
    selected = rows.filter("selected").select(*VOXEL, "row_id")
    fresh = near.join(selected, [*VOXEL, "row_id"], "left_anti").select(*VOXEL, "row_id", F.lit(1).alias("cls"), F.col("pos").alias("ord"))
    return _take(queue.unionByName(fresh), batch)


def next_batch_filtered(postings: DataFrame, rows: DataFrame, matches: DataFrame, batch: int = PICKAXE_BATCH) -> DataFrame:
    """Next matching rows that are not held; the ordinary cursor is neither read nor moved.

    Matches and touched rows meet first, in one shuffle by row; the postings then meet rows that are still wanted, once.
    """
    touched = rows.select("row_id", F.lit(True).alias("touched"))
    state = matches.select("row_id").distinct().join(touched.distinct(), "row_id", "left")
    queue = rows.filter(F.col("state") == "returned").join(state.filter("touched").select("row_id"), "row_id", "left_semi").select(
        *VOXEL, "row_id", F.lit(0).alias("cls"), F.col("seq").alias("ord")
    )
    fresh = postings.join(state.filter(F.col("touched").isNull()).select("row_id"), "row_id", "left_semi").select(
        *VOXEL, "row_id", F.lit(1).alias("cls"), F.col("pos").alias("ord"))
    return _take(queue.unionByName(fresh), batch)


def drain_status(voxels: DataFrame, rows: DataFrame, postings: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """Extracted rows, total, fraction and completeness per voxel; under a filter both count matching rows only."""
    held = rows.filter(F.col("state") == "held")
    if matches is None:
        totals = voxels.select(*VOXEL, F.col("n").alias("total"))
    else:
        held = held.join(matches.select("row_id"), "row_id", "left_semi")
        counted = postings.join(matches.select("row_id"), "row_id", "left_semi").groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("total"))
        totals = voxels.select(*VOXEL).join(counted, VOXEL, "left").na.fill(0, ["total"])
    taken = held.groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("extracted"))
    out = totals.join(taken, VOXEL, "left").na.fill(0, ["extracted"])
    fraction = F.least(F.lit(1.0), F.col("extracted") / F.greatest(F.lit(1), F.col("total")))
    complete = F.col("extracted") >= F.col("total")
    return out.withColumns({"fraction": fraction, "complete": complete & (F.col("total") > 0) if matches is None else complete})


def validate_inventory(stacks: DataFrame, rows: DataFrame, n_rows: int, n_chunks: int, vpc: int) -> DataFrame:
    """Problems of a saved inventory, one row each: where and what.

    stacks: chunk_id, local_id, cursor, total_points, repr_row_id, first_seq, last_seq.
    """
    sizes = rows.groupBy(*VOXEL).agg(
        F.count_if(F.col("state") == "held").alias("held"), F.count_if(F.col("state") == "returned").alias("returned"),
        F.count_if("selected").alias("selected"), F.count_if(F.col("selected") & (F.col("state") != "held")).alias("stray"),
    )
    s = stacks.join(sizes, VOXEL, "left").na.fill(0, ["held", "returned", "selected", "stray"])
    rules = {
        "address": ~(F.col("chunk_id").between(0, n_chunks - 1) & F.col("local_id").between(0, vpc**3 - 1)),
        "no rows": F.col("held") == 0,
        "cursor": ~F.col("cursor").between(0, F.col("total_points")),
        "arithmetic": F.col("held") + F.col("returned") != F.col("cursor") + F.col("selected"),
        "too many rows": F.col("held") + F.col("returned") > F.col("total_points"),
        "representative": ~F.col("repr_row_id").between(0, n_rows - 1),
        "time order": F.col("last_seq") < F.col("first_seq"),
        "selected not held": F.col("stray") > 0,
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    none = F.lit(-1).cast("long")
    broken = s.select(*VOXEL, none.alias("row_id"), F.explode(flags).alias("problem"))
    twice = stacks.groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > 1).select(
        *VOXEL, none.alias("row_id"), F.lit("duplicate stack").alias("problem")
    )
    shared = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("_c")).filter((F.col("_c") > 1) | ~F.col("row_id").between(0, n_rows - 1))
    rowwise = shared.select(none.alias("chunk_id"), none.alias("local_id"), "row_id", F.lit("duplicate or invalid row").alias("problem"))
    return broken.unionByName(twice).unionByName(rowwise)


def verify_prefix(stacks: DataFrame, rows: DataFrame, postings: DataFrame, voxels: DataFrame) -> DataFrame:
    """Rows that contradict the map: held + returned - selected must be the first ``cursor`` postings of the voxel, a
    selected row must belong to it, and count and representative must agree."""
    consumed = postings.join(stacks.select(*VOXEL, "cursor"), VOXEL).filter(F.col("pos") < F.col("cursor")).select(*VOXEL, "row_id")
    claimed = rows.filter(~F.col("selected")).select(*VOXEL, "row_id")
    key = [*VOXEL, "row_id"]
    problem = lambda df, name: df.select(*key, F.lit(name).alias("problem"))
    members = rows.filter("selected").select(*key).join(postings.select(*key), key, "left_anti")
    other = stacks.join(voxels.select(*VOXEL, "n", F.col("repr_row_id").alias("_repr")), VOXEL, "left").filter(
        F.col("n").isNull() | (F.col("n") != F.col("total_points")) | (F.col("_repr") != F.col("repr_row_id"))
    ).withColumn("row_id", F.lit(-1).cast("long"))
    return (
        problem(consumed.join(claimed, key, "left_anti"), "missing from save")
        .unionByName(problem(claimed.join(consumed, key, "left_anti"), "not in the prefix"))
        .unionByName(problem(members, "selected elsewhere"))
        .unionByName(problem(other, "block metadata"))
    )


def collect_hits(hits: DataFrame, row_to_voxel: DataFrame, voxels: DataFrame) -> DataFrame:
    """Descriptor of the voxel of each hit; ``valid`` tells whether the row really lives in the claimed voxel.

    hits: row_id, chunk_id, local_id as claimed.
    """
    actual = row_to_voxel.select("row_id", F.col("chunk_id").alias("_c"), F.col("local_id").alias("_l"))
    valid = F.coalesce((F.col("_c") == F.col("chunk_id")) & (F.col("_l") == F.col("local_id")), F.lit(False))
    return hits.join(actual, "row_id", "left").withColumn("valid", valid).drop("_c", "_l").join(
        voxels.select(*VOXEL, F.col("n").alias("total_points"), "repr_row_id"), VOXEL, "left"
    )


def inventory_page(stacks: DataFrame, page: int, size: int) -> DataFrame:
    """A page of blocks, the most recently extracted first."""
    return stacks.orderBy(F.desc("last_seq"), *VOXEL).offset(page * size).limit(size)


def inventory_rows_page(rows: DataFrame, blocks: DataFrame, page: int = 0, per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """Held rows of the given blocks, newest first, one page of each block."""
    held = rows.filter(F.col("state") == "held").join(blocks.select(*VOXEL), VOXEL, "left_semi")
    top = limit_per_group(held, VOXEL, [F.desc("seq"), "row_id"], (page + 1) * per_page)
    return top.filter(F.col("rank") > page * per_page).select(*VOXEL, "row_id", "rank")
