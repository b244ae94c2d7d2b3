"""3-D queries over the voxel table. Positions and radii are given in the [-1, 1] cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.functions import grid
from embedmap.operators import gridsearch
from embedmap.operators.ordering import limit_per_group, rank_in_group
from embedmap.session import cut

SHELL_FACING = 0.5          # fixed: discount for voxels ahead
CHUNK_FACING = 0.35         # fixed: discount for chunks ahead
POS = ["ux", "uy", "uz"]


PRIORITY_BUCKETS = 64  # buckets per voxel of priority where a probe's shell is ranked whole


def _in_voxels(voxels: DataFrame, n: int, vpc: int) -> DataFrame:
    """Voxel centres in units of one voxel."""
    axes = grid.voxel_axes(F.col("chunk_id"), F.col("local_id"), n, vpc)
    return voxels.withColumns({u: a + F.lit(0.5) for u, a in zip(POS, axes)})


def _placed(voxels: DataFrame, n: int, vpc: int) -> DataFrame:
    """Addresses, row counts and centres, written once, because a search reads them twice."""
    return cut(_in_voxels(voxels, n, vpc).select("chunk_id", "local_id", "n", *POS))


def _probes(probes: DataFrame, n: int) -> DataFrame:
    return probes.withColumns({u: (F.col(p) + F.lit(1.0)) * F.lit(n / 2.0) for u, p in zip(POS, ("px", "py", "pz"))})


def voxels_in_sphere(voxels: DataFrame, probes: DataFrame, radius: float, n: int, vpc: int) -> DataFrame:
    """Occupied voxels whose centre lies within the radius of a probe. probes: q, px, py, pz."""
    hits = gridsearch.within(_placed(voxels, n, vpc), _probes(probes, n), POS, POS, "q", radius * n / 2.0)
    return hits.select("q", "chunk_id", "local_id", "n", (F.col("d2") * F.lit((2.0 / n) ** 2)).alias("d2"))


def voxels_in_shell(voxels: DataFrame, probes: DataFrame, radius: float, n: int, vpc: int, slots: int | None = None) -> DataFrame:
    """Voxels in the one-voxel shell just outside the sphere: nearest first with a discount ahead; only ``slots`` per probe if asked for.

    probes: q, px, py, pz and a unit direction fx, fy, fz.
    """
    r = radius * n / 2.0
    p = _probes(probes, n)
    hits = gridsearch.within(_placed(voxels, n, vpc), p, POS, POS, "q", r + 1.0, inner=r)
    eye = p.select("q", *[F.col(u).alias(f"e{u}") for u in POS], "fx", "fy", "fz")
    ahead = sum((F.col(u) - F.col(f"e{u}")) * F.col(f) for u, f in zip(POS, ("fx", "fy", "fz"))) / F.sqrt("d2")
    ranked = hits.join(eye, "q").withColumn("priority", F.round(F.sqrt("d2") * (F.lit(1.0) - F.lit(SHELL_FACING) * ahead), 9))
    order = ["priority", "chunk_id", "local_id"]
    if slots is None:  # all of them: a probe with very many is ranked in buckets of its priority
        top = rank_in_group(ranked, ["q"], order, "rank", F.floor(F.col("priority") * F.lit(PRIORITY_BUCKETS)).cast("long")).withColumn("rank", F.col("rank") + 1)
    else:
        top = limit_per_group(ranked, ["q"], order, slots)
    return top.select("q", "rank", "chunk_id", "local_id", "n", (F.col("priority") * F.lit(2.0 / n)).alias("priority"))


def nearest_voxel(voxels: DataFrame, probes: DataFrame, n: int, vpc: int, cell_bits: int | None = None) -> DataFrame:
    """Nearest occupied voxel of every probe, exact: q, chunk_id, local_id, distance."""
    side_bits = (n - 1).bit_length()
    bits = min(side_bits, (vpc - 1).bit_length() if cell_bits is None else cell_bits)
    best = gridsearch.nearest(_in_voxels(voxels, n, vpc), _probes(probes, n), POS, POS, "q", ["chunk_id", "local_id"], side_bits, bits)
    return best.select("q", "chunk_id", "local_id", (F.sqrt("d2") * F.lit(2.0 / n)).alias("distance"))


def with_poses(summary: DataFrame, poses: Sequence[tuple], chunks_per_axis: int) -> DataFrame:
    """Every chunk once per camera pose (a short list of parameters) with its distance in chunk edges.

    A pose is (q, px, py, pz) or (q, px, py, pz, fx, fy, fz).
    """
    half = chunks_per_axis / 2.0
    names = ("px", "py", "pz", "fx", "fy", "fz")
    pose = F.explode(F.array(*[
        F.struct(F.lit(p[0]).cast("long").alias("q"), *[F.lit(float(v)).alias(k) for k, v in zip(names, p[1:])]) for p in poses
    ]))
    out = summary.select("chunk_id", "cx", "cy", "cz", "n_points", pose.alias("_p")).select("*", "_p.*").drop("_p")
    out = out.withColumns({d: F.col(c) + F.lit(0.5) - (F.col(p) + F.lit(1.0)) * F.lit(half)
                           for d, c, p in (("dx", "cx", "px"), ("dy", "cy", "py"), ("dz", "cz", "pz"))})
    return out.withColumn("distance", F.sqrt(sum(F.col(d) * F.col(d) for d in ("dx", "dy", "dz"))))


def ring_tiers(summary: DataFrame, poses: Sequence[tuple], radii: tuple[float, float, float], chunks_per_axis: int) -> DataFrame:
    """load / prefetch / keep / evict by the distance in chunk edges."""
    d = F.col("distance")
    tier = F.when(d <= radii[0], "load").when(d <= radii[1], "prefetch").when(d <= radii[2], "keep").otherwise("evict")
    return with_poses(summary, poses, chunks_per_axis).select("q", "chunk_id", "distance", tier.alias("tier"))


def chunk_priority(summary: DataFrame, poses: Sequence[tuple], chunks_per_axis: int, k: int) -> DataFrame:
    """The k chunks to fetch first per pose: distance with a discount for what lies ahead."""
    df = with_poses(summary, poses, chunks_per_axis)
    facing = F.when(F.col("distance") == 0, F.lit(0.0)).otherwise(
        sum(F.col(d) * F.col(f) for d, f in (("dx", "fx"), ("dy", "fy"), ("dz", "fz"))) / F.col("distance")
    )
    scored = df.withColumn("priority", F.round(F.col("distance") * (F.lit(1.0) - F.lit(CHUNK_FACING) * facing), 9))
    return limit_per_group(scored, ["q"], ["priority", "chunk_id"], k).select("q", "rank", "chunk_id", "priority")
