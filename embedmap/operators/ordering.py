"""Ranks, running totals, dense ids and exact percentiles that stay distributed when one group holds most of the rows.

The common device: a group with more than ``HOT_ROWS`` rows is split into order-preserving buckets (``split`` must be a
non-decreasing function of the order within the group). Each (group, bucket) is ranked by itself, and the small
table of bucket totals supplies the offset of every bucket. Nothing is dropped and no task sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embedmap.session import cut

HOT_ROWS = 1 << 20
ID_BITS = 20


def id_bucket(col: Column | str, bits: int = ID_BITS) -> Column:
    """Order-preserving bucket of a non-negative integer id: 2^bits consecutive ids each."""
    col = F.col(col) if isinstance(col, str) else col
    return F.shiftright(col.cast("long"), bits)


def md5_priority(seed: int | str, *cols: Column | str) -> Column:
    """Uniform pseudo-random priority that depends on the key only, not on the layout of the data."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def md5_bucket(priority: Column | str) -> Column:
    """First three hex digits of an md5 priority: 4096 order-preserving buckets."""
    priority = F.col(priority) if isinstance(priority, str) else priority
    return F.conv(F.substring(priority, 1, 3), 16, 10).cast("long")


def with_bucket(df: DataFrame, group: Sequence[str], split: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_bucket``: ``split`` for rows of hot groups, -1 for all others.

    The hot-group list has at most N / hot_rows entries and is found by a map-side combined count.
    """
    if not group:
        return df.withColumn("_bucket", split.cast("long"))
    hot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = hot.select(*group, F.lit(True).alias("_hot"))
    return (
        df.join(F.broadcast(hot), list(group), "left")
        .withColumn("_bucket", F.when(F.col("_hot"), split.cast("long")).otherwise(F.lit(-1).cast("long")))
        .drop("_hot")
    )


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    value: Column,
    out: str,
    split: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exclusive prefix sum of ``value`` inside each group; ``order`` must be total within a group."""
    keys = [*group, "_bucket"]
    tagged = with_bucket(df, group, split, hot_rows).withColumn("_v", value)
    totals = tagged.filter(F.col("_bucket") >= 0).groupBy(*keys).agg(F.sum("_v").alias("_t"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, F.sum("_t").over(earlier).alias("_before"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return (
        tagged.withColumn("_local", F.coalesce(F.sum("_v").over(inner), zero))
        .join(before, keys, "left")
        .withColumn(out, F.col("_local") + F.coalesce("_before", zero))
        .drop("_bucket", "_v", "_local", "_before")
    )


def rank_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    out: str,
    split: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based rank inside each group."""
    return running_total(df, group, order, F.lit(1).cast("long"), out, split, hot_rows)


def limit_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of every group with their 1-based rank.

    Spark limits each group to k rows before the shuffle (WindowGroupLimit), so a hot group sends k rows per task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def position_in_order(
    df: DataFrame,
    outer: Sequence[str],
    inner: Sequence[str],
    order: str,
    out: str,
    split: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based position in the order (outer, inner, order) over the whole table, from counts instead of a global sort.

    ``outer`` has few distinct values (tiles), ``inner`` a bounded number per outer value (cells of a tile).
    """
    keys = [*outer, *inner, "_bucket"]
    tagged = with_bucket(df, [*outer, *inner], split, hot_rows)
    totals = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    up_to = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    tiles = totals.groupBy(*outer).agg(F.sum("_n").alias("_t"))
    tiles = tiles.select(
        *outer, F.coalesce(F.sum("_t").over(Window.orderBy(*outer).rowsBetween(*up_to)), zero).alias("_outer")
    )
    w_cell = Window.partitionBy(*outer).orderBy(*inner, "_bucket").rowsBetween(*up_to)
    cells = totals.select(*keys, F.coalesce(F.sum("_n").over(w_cell), zero).alias("_inner")).join(tiles, list(outer))
    w_row = Window.partitionBy(*keys).orderBy(order)
    return (
        tagged.withColumn("_local", F.row_number().over(w_row) - 1)
        .join(cells, keys)
        .withColumn(out, (F.col("_outer") + F.col("_inner") + F.col("_local")).cast("long"))
        .drop("_bucket", "_local", "_inner", "_outer")
    )


def dense_row_id(df: DataFrame, order: Sequence[str], out: str = "row_id") -> DataFrame:
    """Dense id 0..N-1 in the given total order.

    The range-partitioned, sorted rows are checkpointed first: range bounds come from a sample, so both passes must
    read the same written partitions. One row per partition is all that the offset window sees.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = cut(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part, pos = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    tagged = tagged.withColumn("_part", part).withColumn("_pos", pos).drop("_mid")
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_offset") + F.col("_pos")).cast("long"))
        .drop("_part", "_pos", "_offset")
    )


def linspace_ids(n: int, k: int) -> Column:
    """Array-free rule for k evenly spaced ids of 0..n-1: id of step ``i`` (column ``id`` of ``range(k)``)."""
    if k <= 1:
        return F.lit(0).cast("long")
    return F.floor(F.col("id") * (n - 1) / F.lit(k - 1)).cast("long")


_SKETCH = 10_000


_BINS = 1024


def exact_percentiles(df: DataFrame, group: Sequence[str], cols: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated percentiles in long form: (*group, col, p, value).

    Rank selection per group, in tasks: a sketch brackets every wanted rank, a first pass counts the rows below, beyond and in ``_BINS`` bins of
    the bracket, and a second one lists the distinct values of the one bin that holds the rank. A window sees the bins of a rank or
    the values of one bin, never a group. Should the sketch be wrong, the bin that holds the rank is merely wider.
    """
    margin = 2.0 / _SKETCH
    long = df.select(
        *group,
        F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_e"),
    ).select(*group, "_e.col", "_e.v").filter(F.col("v").isNotNull())
    keys = [*group, "col"]
    # Null groups are groups too, so the keys are told apart by a struct, which joins like any value.
    long = long.withColumn("_k", F.struct(*[F.struct(F.col(k).isNull(), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys]))
    sketch = long.groupBy("_k").agg(
        F.percentile_approx("v", [max(0.0, p - margin) for p in ps] + [min(1.0, p + margin) for p in ps], _SKETCH).alias("_q"), F.count(F.lit(1)).alias("_n"),
        *[F.first(k).alias(k) for k in keys])
    wanted = [F.struct(F.lit(float(p)).alias("p"), F.col("_q")[i].alias("lo"), F.col("_q")[len(ps) + i].alias("hi")) for i, p in enumerate(ps)]
    sketch = cut(sketch)
    brackets = sketch.select("_k", "_n", F.explode(F.array(*wanted)).alias("_w")).select("_k", "_n", "_w.*")
    inside = F.least(F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(5e-324)) * _BINS), F.lit(_BINS - 1))
    bin_ = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), _BINS).otherwise(inside)
    steps = long.select("_k", "v").join(small(brackets), "_k").groupBy("_k", "p", "_n", bin_.cast("int").alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("v").alias("_lowest"), F.max("v").alias("_highest"))
    before = lambda order: Window.partitionBy("_k", "p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    steps = steps.withColumn("_below", F.coalesce(F.sum("_c").over(before("_bin")), none))
    position = F.col("p") * (F.col("_n") - 1)
    ranks = F.array_distinct(F.array(F.floor(position), F.ceil(position)))
    held = F.filter(ranks, lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c")))
    steps = cut(steps.select("_k", "p", "_n", "_below", "_lowest", "_highest", F.explode(held).alias("_rank")))
    known = steps.filter(F.col("_lowest") == F.col("_highest")).select("_k", "p", "_n", "_rank", F.col("_lowest").alias("_v"))
    open_ = steps.filter(F.col("_lowest") < F.col("_highest"))
    # Both ranks of a percentile may lie in one bin: its values are listed once for each.
    listed = long.select("_k", "v").join(small(open_), "_k").filter(F.col("v").between(F.col("_lowest"), F.col("_highest")))
    listed = listed.groupBy("_k", "p", "_n", "_rank", "_below", "v").agg(F.count(F.lit(1)).alias("_c"))
    at = Window.partitionBy("_k", "p", "_rank").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_below") + F.coalesce(F.sum("_c").over(at), none)
    listed = listed.withColumn("_start", start).filter((F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_start") + F.col("_c")))
    found = known.unionByName(listed.select("_k", "p", "_n", "_rank", F.col("v").alias("_v"))).groupBy("_k", "p").agg(
        F.min_by("_v", "_rank").alias("_a"), F.max_by("_v", "_rank").alias("_b"), F.max(position).alias("_at"))
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        (F.ceil("_at") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.floor("_at")) * F.col("_b"))
    return found.join(sketch.select("_k", *keys), "_k").select(*keys, "p", value.alias("value"))


#: Rows of a table of short rows that may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is: the join is then a shuffle that AQE splits where it is skewed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
