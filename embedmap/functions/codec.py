"""Composite integer keys as Column arithmetic, held in BIGINT.

The low field of a packed reference or voxel has a fixed width; the high one takes what is left of a BIGINT, since no field follows
it. Whether a key also fits the unsigned 32 bits of the stored format is told by ``ref_in_range`` and ``voxel_in_range``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed field widths of the packed keys.
REF_LOCALS = 65536        # rows per shard in a packed reference
POINT_ROWS = 1 << 28      # row ids in a packed 2-D point
POINT_CORPORA = 16        # corpora in a packed 2-D point
VOXEL_LOCALS = 1 << 12    # local ids in a packed voxel
VOXEL_CHUNKS = 1 << 20    # chunks in a packed voxel
U32 = 1 << 32


def _guarded(packed: Column, ok: Column, known: Column, what: str) -> Column:
    """``packed`` where ``ok``; null for null parts; any other value stops the job instead of spilling into the next field."""
    return F.when(ok, packed).when(known, F.raise_error(F.lit(f"{what} out of range")).cast("long"))


def _fits(high: Column, low: Column, lows: int) -> Column:
    return high.between(0, ((1 << 63) // lows) - 1) & low.between(0, lows - 1)


def pack_ref(shard: Column, local: Column) -> Column:
    packed = F.shiftleft(shard.cast("long"), 16).bitwiseOR(local.cast("long"))
    return _guarded(packed, _fits(shard, local, REF_LOCALS), shard.isNotNull() & local.isNotNull(), "shard or local row of a packed reference")


def unpack_ref(ref: Column) -> tuple[Column, Column]:
    ref = ref.cast("long")
    return F.shiftright(ref, 16), ref.bitwiseAND(REF_LOCALS - 1)


def ref_in_range(shard: Column, local: Column) -> Column:
    return shard.between(0, U32 // REF_LOCALS - 1) & local.between(0, REF_LOCALS - 1)


def pack_point(corpus: Column, row_id: Column) -> Column:
    packed = F.shiftleft(corpus.cast("long"), 28).bitwiseOR(row_id.cast("long"))
    return _guarded(packed, point_in_range(corpus, row_id), corpus.isNotNull() & row_id.isNotNull(), "corpus or row id of a packed point")


def unpack_point(packed: Column) -> tuple[Column, Column]:
    packed = packed.cast("long")
    return F.shiftright(packed, 28), packed.bitwiseAND(POINT_ROWS - 1)


def point_in_range(corpus: Column, row_id: Column) -> Column:
    return corpus.between(0, POINT_CORPORA - 1) & row_id.between(0, POINT_ROWS - 1)


def pack_voxel(chunk: Column, local: Column) -> Column:
    packed = F.shiftleft(chunk.cast("long"), 12).bitwiseOR(local.cast("long"))
    return _guarded(packed, _fits(chunk, local, VOXEL_LOCALS), chunk.isNotNull() & local.isNotNull(), "chunk or local id of a packed voxel")


def unpack_voxel(packed: Column) -> tuple[Column, Column]:
    packed = packed.cast("long")
    return F.shiftright(packed, 12), packed.bitwiseAND(VOXEL_LOCALS - 1)


def voxel_in_range(chunk: Column, local: Column) -> Column:
    return chunk.between(0, VOXEL_CHUNKS - 1) & local.between(0, VOXEL_LOCALS - 1)
