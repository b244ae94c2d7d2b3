"""Grid arithmetic: 3-D voxel addresses, 2-D quantised tiles, density scales. All narrow Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 2-D pyramid.
TILE_BINS = 256
MAX_ZOOM = 5
QUANT_LEVELS = 65536


def floordiv(a: Column, b: int) -> Column:
    """Integer quotient of a non-negative BIGINT: a shift for powers of two."""
    if b & (b - 1) == 0:
        return F.shiftright(a.cast("long"), b.bit_length() - 1)
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def known(index: Column) -> Column:
    """Mark a cell address as never null: a missing coordinate gives -1, an address outside every grid.

    Joins on a nullable computed key make the optimiser push a null test of the whole expression down to the scan.
    """
    return F.coalesce(index, F.lit(-1).cast("long"))


# --- 3-D ------------------------------------------------------------------------------------------------------------

def normalized(c: Column, lo: float, hi: float) -> Column:
    """Affine map of [lo, hi] onto [-1, 1]; values outside stay outside."""
    return (c - F.lit(lo)) / F.lit(hi - lo) * F.lit(2.0) - F.lit(1.0)


def bin_axis(c: Column, n: int) -> Column:
    """Bin of a normalised coordinate, clipped into the edge bins."""
    raw = F.floor((c + F.lit(1.0)) / F.lit(2.0) * F.lit(float(n)))
    return F.least(F.greatest(raw, F.lit(0).cast("long")), F.lit(n - 1).cast("long"))


def flat_index(vx: Column, vy: Column, vz: Column, n: int) -> Column:
    """Row-major index, x fastest."""
    return vx + (vy + vz * n) * n


def require_divisible(n: int, vpc: int) -> None:
    if n < 1 or vpc < 1 or n % vpc:
        raise ValueError(f"grid {n} is not a multiple of the chunk side {vpc}")


def chunk_of(vx: Column, vy: Column, vz: Column, n: int, vpc: int) -> Column:
    require_divisible(n, vpc)
    return known(flat_index(floordiv(vx, vpc), floordiv(vy, vpc), floordiv(vz, vpc), n // vpc))


def local_of(vx: Column, vy: Column, vz: Column, vpc: int) -> Column:
    return known(flat_index(vx % vpc, vy % vpc, vz % vpc, vpc))


def axes_of(index: Column, side: int) -> tuple[Column, Column, Column]:
    """Inverse of ``flat_index`` for a cube of the given side."""
    return index % side, floordiv(index, side) % side, floordiv(index, side * side)


def voxel_axes(chunk: Column, local: Column, n: int, vpc: int) -> tuple[Column, Column, Column]:
    """Grid coordinates of a voxel from its address."""
    return tuple(c * vpc + l for c, l in zip(axes_of(chunk, n // vpc), axes_of(local, vpc)))


def cell_center(v: Column, n: int) -> Column:
    """Centre of bin ``v`` in the [-1, 1] cube."""
    return (v + F.lit(0.5)) * F.lit(2.0 / n) - F.lit(1.0)


# --- 2-D ------------------------------------------------------------------------------------------------------------

def choose_max_zoom(n: int) -> int:
    """Smallest zoom whose finest grid has at least n bins, capped."""
    return next((z for z in range(MAX_ZOOM) if (TILE_BINS << z) ** 2 >= n), MAX_ZOOM)


def quantized(offset: Column, span: float) -> Column:
    raw = F.floor(offset / F.lit(span) * F.lit(float(QUANT_LEVELS)))
    return known(F.least(F.greatest(raw, F.lit(0).cast("long")), F.lit(QUANT_LEVELS - 1).cast("long")))


def quantize_xy(x: Column, y: Column, extent: list[float]) -> tuple[Column, Column]:
    """16-bit coordinates of the frame; y grows downward from the top edge."""
    x0, x1, y0, y1 = extent
    return quantized(x - F.lit(x0), x1 - x0), quantized(F.lit(y1) - y, y1 - y0)


def dequantize_xy(qx: Column, qy: Column, extent: list[float]) -> tuple[Column, Column]:
    """Centre of the quantisation step in data units."""
    x0, x1, y0, y1 = extent
    step = F.lit(float(QUANT_LEVELS))
    return (
        F.lit(x0) + (qx + F.lit(0.5)) / step * F.lit(x1 - x0),
        F.lit(y1) - (qy + F.lit(0.5)) / step * F.lit(y1 - y0),
    )


def bins_at(q: Column, zoom: int) -> Column:
    if not 0 <= zoom <= 8:
        raise ValueError("zoom must be within 0..8 for 16-bit coordinates")
    return F.shiftright(q.cast("long"), 8 - zoom)


def _spread8(v: Column) -> Column:
    """Move the low 8 bits to the even positions."""
    v = v.bitwiseAND(0xFF)
    for shift, mask in ((4, 0x0F0F), (2, 0x3333), (1, 0x5555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
    return v


def morton(bx: Column, by: Column) -> Column:
    """Z-order key of two 8-bit values, x in the even bits."""
    return _spread8(bx.cast("long")).bitwiseOR(F.shiftleft(_spread8(by.cast("long")), 1))


def tile_of(bx: Column, by: Column, zoom: int) -> Column:
    """Row-major tile id of a bin at the given zoom."""
    return F.shiftleft(F.shiftright(by, 8), zoom).bitwiseOR(F.shiftright(bx, 8))


def tile_sort_key(qx: Column, qy: Column, zoom: int) -> Column:
    bx, by = bins_at(qx, zoom), bins_at(qy, zoom)
    return F.shiftleft(tile_of(bx, by, zoom), 16).bitwiseOR(morton(bx, by))


# --- scales -----------------------------------------------------------------------------------------------------------

def density_level(n: Column) -> Column:
    """0..1 on a log scale; 10,000 and more saturates."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(F.greatest(F.lit(1.0), n.cast("double"))) / F.lit(4.0)))


def log2_floor(n: Column) -> Column:
    """floor(log2(n)) of a positive BIGINT, exact: the length of its binary form minus one."""
    return (F.length(F.bin(n.cast("long"))) - 1).cast("long")


def density_log2(n: Column) -> Column:
    return F.least(log2_floor(n + F.lit(1)), F.lit(255).cast("long"))


def compact_side(n: Column) -> Column:
    """Smallest power of two whose square holds n tiles: with n-1 < 4^k, the side is 2^k."""
    bits = F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(F.greatest(n, F.lit(2)).cast("long") - 1)))
    return F.pow(F.lit(2.0), F.floor((bits + 1) / F.lit(2))).cast("long")
