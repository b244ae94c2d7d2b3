"""Robust coordinate frames and the addresses derived from them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.functions import grid

# Fixed values of the frame rule.
EXTENT_PCT = (0.001, 0.999)
PAD_FRACTION = 0.02
CORE_RADIUS_PCT = 0.995
SKETCH = 10_000             # accuracy of the sketch that brackets a percentile
HISTOGRAM_BINS = 4096       # bins per open interval of a percentile search
LIST_ROWS = 20_000          # an interval this small is listed value by value


@dataclass(frozen=True)
class Frame:
    """Extent as [lo, hi] per axis, flattened."""

    extent: list[float]
    raw_extent: list[float]
    pct: tuple[float, float] = EXTENT_PCT
    pad: float = PAD_FRACTION
    n_rows: int | None = None


def linspace_sample(df: DataFrame, n: int, k: int, id_col: str = "row_id") -> DataFrame:
    """Rows floor(i*(n-1)/(k-1)), i < k, of a dense id, found by a narrow integer predicate."""
    if k >= n:
        return df
    if k == 1:
        return df.filter(F.col(id_col) == 0)
    row = F.col(id_col).cast("decimal(38,0)")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("decimal(20,0)"))
    step = div(row * (k - 1) + (n - 2), n - 1).cast("decimal(20,0)")
    return df.filter(div(step * (n - 1), k - 1) == F.col(id_col))


def percentiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float]) -> dict[str, list[float]]:
    """Exact interpolated percentiles of a few columns, as driver scalars.

    Rank selection: the first pass sketches every column (``percentile_approx``), which brackets each wanted rank. The second counts the
    rows in and around the brackets and lists the distinct values of small ones; a bracket with more rows is narrowed by
    histogram, pass by pass. A bracket that turns out not to hold its rank is replaced by the gap that does, so the result never rests on
    the sketch. The driver sees counts only, whatever the number of rows or their skew. Nulls are left out; NaN and
    infinite values have no place in the search and are refused, as is a column without values.
    """
    return _percentiles(df, cols, ps)[0]


def _percentiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float]) -> tuple[dict[str, list[float]], int]:
    """Percentiles and the number of rows, nulls included."""
    values = {i: F.col(c).cast("double") for i, c in enumerate(cols)}
    edges = sorted({e for p in ps for e in (max(0.0, p - 2 / SKETCH), min(1.0, p + 2 / SKETCH))})
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"), *[f(v).alias(f"{k}{i}") for i, v in values.items() for k, f in (("n", F.count), ("a", F.min), ("b", F.max))],
        *[F.count_if(F.isnan(v) | (F.abs(v) == F.lit(float("inf")))).alias(f"x{i}") for i, v in values.items()],
        *[F.percentile_approx(v, F.array(*[F.lit(e) for e in edges]), F.lit(SKETCH)).alias(f"s{i}") for i, v in values.items()]).first()
    for i, c in enumerate(cols):
        if stats[f"x{i}"]:
            raise ValueError(f"{c} has {stats[f'x{i}']} NaN or infinite values")
        if not stats[f"n{i}"]:
            raise ValueError(f"{c} has no values")
    found: dict[tuple[int, int], float] = {}
    # Intervals (column, lo, hi) that cover the column; values at an edge belong to the interval above, the largest to the last.
    todo: list[_Interval] = []
    for i in range(len(cols)):
        ranks = sorted({r for p in ps for r in _rank_pair(p, stats[f"n{i}"])})
        low, high, at = stats[f"a{i}"], stats[f"b{i}"], dict(zip(edges, stats[f"s{i}"]))
        brackets = [(at[max(0.0, p - 2 / SKETCH)], math.nextafter(at[min(1.0, p + 2 / SKETCH)], math.inf)) for p in ps]
        cuts = sorted({low, high, *(e for b in brackets for e in b if low < e < high)})
        marks = cuts if len(cuts) > 1 else cuts * 2
        inside = lambda lo, hi: any(a <= lo and hi <= b for a, b in brackets)  # noqa: E731, B023
        todo.append(_Interval(i, 0, ranks, [_Piece(lo, hi, stats[f"n{i}"] * 8 // SKETCH if inside(lo, hi) else None) for lo, hi in zip(marks, marks[1:])]))
    while todo:
        todo = _narrow(df, cols, todo, found)
    out = {}
    for i, c in enumerate(cols):
        out[c] = []
        for p in ps:
            lower, upper = _rank_pair(p, stats[f"n{i}"])
            position = p * (stats[f"n{i}"] - 1)
            x, y = found[i, lower], found[i, upper]
            out[c].append(x if x == y else (upper - position) * x + (position - lower) * y)
    return out, stats["rows"]


def _rank_pair(p: float, n: int) -> tuple[int, int]:
    return math.floor(p * (n - 1)), math.ceil(p * (n - 1))


@dataclass
class _Piece:
    """Values in [lo, hi), the last piece of an interval with hi; the rows that are expected in it, None if it is only counted."""

    lo: float
    hi: float
    rows: int | None


@dataclass
class _Interval:
    """Adjoining pieces of a column's values, the rows below them, and the ranks that lie inside."""

    column: int
    below: int
    ranks: list[int]
    pieces: list[_Piece]


def _narrow(df: DataFrame, cols: Sequence[str], todo: list[_Interval], found: dict[tuple[int, int], float]) -> list[_Interval]:
    """One counting pass over all open intervals in one scan; returns the smaller ones that remain open."""
    keys = [(t, p) for t in todo for p in t.pieces]
    marks = []
    for i in sorted({t.column for t in todo}):
        v = F.col(cols[i]).cast("double")
        which, mark = F.lit(None).cast("int"), F.lit(None).cast("double")
        for j, (t, p) in enumerate(keys):
            if t.column == i:
                inside = v.between(p.lo, p.hi) if p is t.pieces[-1] else (v >= F.lit(p.lo)) & (v < F.lit(p.hi))
                if p.rows is None:
                    scaled = F.lit(0.0)
                elif p.rows <= LIST_ROWS or p.hi <= p.lo:  # few rows: list the distinct values
                    scaled = v
                else:
                    scaled = F.floor((v - F.lit(p.lo)) / F.lit(p.hi - p.lo) * F.lit(float(HISTOGRAM_BINS))).cast("double")
                which, mark = F.when(inside, F.lit(j)).otherwise(which), F.when(inside, scaled).otherwise(mark)
        marks.append(F.struct(v.alias("v"), which.alias("j"), mark.alias("bin")))
    kept = F.filter(F.array(*marks), lambda m: m["j"].isNotNull())
    counted = df.select(F.explode(kept).alias("m")).groupBy("m.j", "m.bin").agg(F.count(F.lit(1)).alias("n"), F.min("m.v").alias("lo"), F.max("m.v").alias("hi")).collect()
    rest = []
    for t in todo:
        mine = {id(p) for p in t.pieces}
        below = t.below
        for r in sorted((r for r in counted if id(keys[r["j"]][1]) in mine), key=lambda r: (r["j"], r["lo"])):
            here = [k for k in t.ranks if below <= k < below + r["n"]]
            if here and r["lo"] == r["hi"]:
                found.update({(t.column, k): r["lo"] for k in here})
            elif here:
                rest.append(_Interval(t.column, below, here, [_Piece(r["lo"], r["hi"], r["n"])]))
            below += r["n"]
    return rest


def padded(lo: float, hi: float, pad: float) -> tuple[float, float]:
    if lo == hi:
        return lo - 1.0, hi + 1.0
    margin = pad * (hi - lo)
    return lo - margin, hi + margin


def robust_extent(df: DataFrame, cols: Sequence[str], pct: tuple[float, float] = EXTENT_PCT, pad: float = PAD_FRACTION) -> list[float]:
    return _extent(df, cols, pct, pad)[0]


def _extent(df: DataFrame, cols: Sequence[str], pct: tuple[float, float] = EXTENT_PCT, pad: float = PAD_FRACTION) -> tuple[list[float], int]:
    q, rows = _percentiles(df, cols, pct)
    return [edge for c in cols for edge in padded(*q[c], pad)], rows


def equalized(extent: Sequence[float]) -> list[float]:
    """Grow the shorter axes about their centre to the largest span (a square or a cube)."""
    pairs = list(zip(extent[::2], extent[1::2]))
    half = max(hi - lo for lo, hi in pairs) / 2
    return [edge for lo, hi in pairs for edge in ((lo + hi) / 2 - half, (lo + hi) / 2 + half)]


def compute_frame_3d(df: DataFrame, cols: Sequence[str] = ("x", "y", "z"), n: int | None = None) -> Frame:
    """Frame of all rows. To fit one on fewer, pass them: ``compute_frame_3d(linspace_sample(df, n, k))``."""
    raw, rows = _extent(df, cols)
    return Frame(equalized(raw), raw, n_rows=rows if n is None else n)


def compute_frame_2d(df: DataFrame, cols: Sequence[str] = ("x", "y"), n: int | None = None) -> Frame:
    """Extent of the trimmed core: rows within the 99.5 percentile of the distance to the median."""
    x, y = cols
    centre, rows = _percentiles(df, cols, [0.5])
    dx, dy = F.col(x) - F.lit(centre[x][0]), F.col(y) - F.lit(centre[y][0])
    radial = df.withColumn("_radius", F.sqrt(dx * dx + dy * dy))
    limit = percentiles(radial, ["_radius"], [CORE_RADIUS_PCT])["_radius"][0]
    raw = robust_extent(radial.filter(F.col("_radius") <= F.lit(limit)), cols)
    return Frame(equalized(raw), raw, n_rows=rows if n is None else n)


def normalize(df: DataFrame, frame: Frame, cols: Sequence[str] = ("x", "y", "z"), out: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    e = frame.extent
    return df.withColumns({o: grid.normalized(F.col(c), e[2 * i], e[2 * i + 1]) for i, (c, o) in enumerate(zip(cols, out))})


def nonfinite(cols: Sequence[str]) -> Column:
    flags = [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))) for c in cols]
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def normalize_queries(df: DataFrame, frame: Frame, cols: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Query positions in the fixed frame; ``invalid`` marks null or non-finite input, ``outside_frame`` the rest."""
    out = normalize(df.withColumn("invalid", nonfinite(cols)), frame, cols)
    beyond = F.greatest(*[F.abs(F.col(c)) for c in ("px", "py", "pz")[: len(cols)]]) > 1
    return out.withColumn("outside_frame", F.when(F.col("invalid"), F.lit(None)).otherwise(beyond))


def voxel_bins(df: DataFrame, n: int, cols: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    return df.withColumns({o: grid.bin_axis(F.col(c), n) for c, o in zip(cols, ("vx", "vy", "vz"))})


def address(df: DataFrame, n: int, vpc: int) -> DataFrame:
    """chunk_id and local_id from vx, vy, vz."""
    v = [F.col(c) for c in ("vx", "vy", "vz")]
    return df.withColumns({"chunk_id": grid.chunk_of(*v, n, vpc), "local_id": grid.local_of(*v, vpc)})


def assign_points(df: DataFrame, frame: Frame, n: int, vpc: int) -> DataFrame:
    """Points with normalised coordinates, bins and voxel address: one narrow projection, no shuffle."""
    grid.require_divisible(n, vpc)
    return address(voxel_bins(normalize(df, frame), n), n, vpc)


def chunk_bbox(df: DataFrame, chunks_per_axis: int) -> DataFrame:
    """Grid coordinates and bounding box of ``chunk_id`` in the [-1, 1] cube."""
    axes = dict(zip(("cx", "cy", "cz"), grid.axes_of(F.col("chunk_id"), chunks_per_axis)))
    side = 2.0 / chunks_per_axis
    edges = {}
    for c, a in zip(("x", "y", "z"), ("cx", "cy", "cz")):
        edges[f"{c}0"] = F.col(a) * F.lit(side) - F.lit(1.0)
        edges[f"{c}1"] = (F.col(a) + 1) * F.lit(side) - F.lit(1.0)
    return df.withColumns(axes).withColumns(edges)


def voxel_center(df: DataFrame, n: int, vpc: int) -> DataFrame:
    """Centre of each voxel address in the [-1, 1] cube."""
    v = grid.voxel_axes(F.col("chunk_id"), F.col("local_id"), n, vpc)
    return df.withColumns({o: grid.cell_center(a, n) for o, a in zip(("wx", "wy", "wz"), v)})


def quantize(df: DataFrame, frame: Frame, x: str = "x", y: str = "y") -> DataFrame:
    qx, qy = grid.quantize_xy(F.col(x), F.col(y), frame.extent)
    return df.withColumns({"qx": qx, "qy": qy})


def dequantize(df: DataFrame, frame: Frame) -> DataFrame:
    x, y = grid.dequantize_xy(F.col("qx"), F.col("qy"), frame.extent)
    return df.withColumns({"dx": x, "dy": y})
