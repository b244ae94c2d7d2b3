"""Temperature mixing of sources.

The token share s of every source becomes the weight s^t / sum(s^t). The exponent t is bisected on a grid of 2^-20: it is the
largest at which the weights reach ``entropy`` (a share of the evenest possible), but not so small that a source would be repeated more
than ``max_repeat`` times; the limit wins. With budget ``cover`` the least repeated source is seen exactly once, so that no
document is lost; else the budget is a number of tokens.

A source's budget is realised by permutations: every pass over the source is a fresh order by md5(seed, pass, id), and the
last pass ends where the budget is met. The order is cut into buckets by the leading bits of the md5; a bucket is sorted by itself, and
sums per bucket and per thousand buckets supply the offsets, so no task orders a whole source. The place within the
source's budget decides the block of the mix, which therefore holds all sources in their weights.

Defined cases: a null or empty source is the source ''; a null text counts as one token, as does the end of every text; equal rows
are drawn in any order among themselves; an empty table gives no rows; other columns pass through, whatever their names, and ``_mix`` is
the only new name (a column of that name gives way to it).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedmap.llm.tables import carried, released, small, stored

GRID = 1 << 20
#: Exponents tried per pass over the table of sources.
CUTS = 16
#: Tokens in a bucket of a permutation and in a block of the mix.
BUCKET_TOKENS = 32_768
BLOCK_TOKENS = 1 << 20
BUCKETS = 1024


def word_count(text: Column) -> Column:
    """Words of a text and its end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def _largest(sources: DataFrame, holds) -> int:
    """Largest step of the grid at which ``holds`` is true, where it is true up to some step and false beyond; -1 if nowhere.

    ``holds`` gets the exponent, the entropy of the weights, their norm and the least and the largest share.
    """
    s, low, high = F.col("share"), -1, GRID + 1
    while high - low > 1:
        steps = sorted({low + (high - low) * i // CUTS for i in range(1, CUTS)} - {low, high})
        powers = [F.pow(s, F.lit(k / GRID)) for k in steps]
        seen = sources.agg(F.min(s), F.max(s), *[F.sum(p) for p in powers], *[F.sum(p * F.log(s)) for p in powers]).first()
        for i, k in enumerate(steps):
            t, norm, weighted = k / GRID, seen[2 + i], seen[2 + len(steps) + i]
            if not holds(t, math.log(norm) - t * weighted / norm, norm, seen[0], seen[1]):
                high = k
                break
            low = k
    return low


def exponent(sources: DataFrame, entropy: float, max_repeat: float, passes: float | None) -> float:
    """Exponent for the sources (source, share); ``passes`` is budget / tokens, None for covering budgets."""
    n = sources.count()
    if n < 2:
        return 1.0
    even = _largest(sources, lambda t, h, norm, least, most: h >= entropy * math.log(n))

    def repeated(t, h, norm, least, most) -> bool:
        """Whether the rarest source is repeated too often; true up to some exponent."""
        return t < 1 and (passes * least ** (t - 1) / norm if passes else (least / most) ** (t - 1)) > max_repeat

    over = _largest(sources, repeated)
    return min(max(even, over + 1, 0), GRID) / GRID


def source_budgets(docs: DataFrame, tokens: Column, source: Column, budget: int | str, entropy: float, max_repeat: float) -> DataFrame:
    """One row per source: tokens, weight, and the tokens that the mix takes from it."""
    sources = stored(docs.select(source.alias("_source"), tokens.alias("_tokens")).groupBy("_source").agg(F.sum("_tokens").alias("tokens")))
    total, least, most = sources.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not total:
        return sources.select("_source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    shares = sources.withColumn("share", F.col("tokens") / F.lit(total))
    t = exponent(shares, entropy, max_repeat, None if budget == "cover" else budget / total)
    norm = shares.agg(F.sum(F.pow("share", F.lit(t)))).first()[0]
    weight = F.pow("share", F.lit(t)) / F.lit(norm)
    # Covering: the source with the largest weight per token of its own is not the scarce one; the one with the least is seen once.
    whole = F.lit(float(budget)) if budget != "cover" else F.lit(most / ((most / total) ** t / norm))
    rounded = F.floor(weight * whole + F.lit(1e-6))
    if budget == "cover":
        rounded = F.greatest(rounded, F.col("tokens"))
    return shares.select("_source", "tokens", weight.alias("weight"), rounded.cast("long").alias("budget"))


def mix(docs: DataFrame, budget: int | str = "cover", entropy: float = 0.98, max_repeat: float = 4.0, seed: int = 7, tokens: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_tokens: int = BUCKET_TOKENS,
        block_tokens: int = BLOCK_TOKENS, into: str = "_mix") -> DataFrame:
    """The rows of the mix: ``docs`` with the struct ``into`` (epoch, block, order, tokens, source_tokens, source_budget)."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    tokens = word_count(F.col(text_col)) if tokens is None else tokens
    # The texts are counted once for the budgets and the offsets, and once more where the rows are drawn.
    slim = stored(docs.select(source.alias("_source"), F.col(id_col).cast("string").alias("_id"), tokens.alias("_tokens")))
    budgets = stored(source_budgets(slim, F.col("_tokens"), F.col("_source"), budget, entropy, max_repeat))
    whole = budgets.agg(F.sum("budget")).first()[0] or 0
    blocks = max(1, -(-whole // block_tokens))
    named = small(budgets.select("_source", F.col("tokens").alias("_of"), F.col("budget").alias("_budget")))

    def drawn(rows: DataFrame) -> DataFrame:
        """A row per document and pass, with its bucket in the order of that pass."""
        rows = rows.join(named, "_source")
        passes = F.ceil(F.col("_budget") / F.col("_of"))
        rows = rows.filter(passes > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_epoch").cast("string"), F.coalesce(F.col("_id"), F.lit(""))).cast("binary"))
        lead = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        return rows.withColumn("_order", order).withColumn("_bucket", F.floor(lead * F.ceil(F.col("_of") / bucket_tokens)))

    keys = ["_source", "_epoch", "_bucket"]
    sums = drawn(slim).groupBy(*keys).agg(F.sum("_tokens").alias("_sum")).withColumn("_part", F.floor(F.col("_bucket") / BUCKETS))
    upto = (Window.unboundedPreceding, -1)
    parts = sums.groupBy("_source", "_epoch", "_part").agg(F.sum("_sum").alias("_sum"))
    none = F.lit(0).cast("long")
    earlier = F.coalesce(F.sum("_sum").over(Window.partitionBy("_source", "_epoch").orderBy("_part").rowsBetween(*upto)), none)
    parts = parts.select("_source", "_epoch", "_part", earlier.alias("_before_part"))
    inside = F.coalesce(F.sum("_sum").over(Window.partitionBy("_source", "_epoch", "_part").orderBy("_bucket").rowsBetween(*upto)), none)
    offsets = sums.withColumn("_inside", inside).join(parts, ["_source", "_epoch", "_part"]).select(*keys, (F.col("_inside") + F.col("_before_part")).alias("_offset"))

    rows = carried(docs, into, _source=source, _id=F.col(id_col).cast("string"), _tokens=tokens)
    running = Window.partitionBy(*keys).orderBy("_order", "_id").rowsBetween(*upto)
    placed = drawn(rows).withColumn("_local", F.coalesce(F.sum("_tokens").over(running), none)).join(offsets, keys)
    start = F.col("_epoch") * F.col("_of") + F.col("_offset") + F.col("_local")
    placed = placed.withColumn("_start", start).filter(F.col("_start") + F.col("_tokens") <= F.col("_budget"))
    block = F.least(F.floor(F.col("_start").cast("decimal(38,0)") * blocks / F.col("_budget")).cast("long"), F.lit(blocks - 1))
    struct = F.struct(F.col("_epoch").alias("epoch"), block.alias("block"), F.col("_order").alias("order"), F.col("_tokens").alias("tokens"),
                      F.col("_of").alias("source_tokens"), F.col("_budget").alias("source_budget"))
    return released(placed, docs.columns, into, struct)
