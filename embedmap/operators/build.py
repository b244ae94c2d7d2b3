"""One guarded build of a map: checks first, tables written once, audits on what was written, manifest last."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedmap.operators import audits, frames, lod, voxels
from embedmap.operators.keys import ContractError, check_dense
from embedmap.session import cut
from embedmap.sources.release import publish_release

COORDS = ("x", "y", "z")


def _refuse(found: DataFrame, what: str) -> None:
    first = found.limit(3).collect()
    if first:
        raise ContractError(f"{what}: {[tuple(r) for r in first]}")


def input_problems(points: DataFrame) -> None:
    """Refuse row ids that aren't 0..n-1 and coordinates that are missing or not finite."""
    if not check_dense(points, "row_id").first()["dense"]:
        raise ContractError("row ids are not dense")
    _refuse(points.filter(frames.nonfinite(COORDS)).select("row_id", *COORDS), "coordinates that are not finite")


def map_tables(points: DataFrame, n: int, vpc: int, limit: int | None = None) -> tuple[dict[str, DataFrame], frames.Frame]:
    """All tables of a map from points (row_id, x, y, z, r, g, b), refusing voxels with more than ``limit`` rows."""
    input_problems(points)
    frame = frames.compute_frame_3d(points)
    placed = cut(frames.assign_points(points, frame, n, vpc))
    vox = cut(voxels.representatives(placed, n))
    if limit is not None:
        _refuse(vox.filter(F.col("n") > limit).select("chunk_id", "local_id", "n"), f"voxels with more than {limit} rows")
    summary = voxels.chunk_summary(vox, n // vpc)
    records = voxels.voxel_records(vox, points)
    return {
        "points": placed, "postings": voxels.postings(placed), "voxels": vox, "records": records, "chunks": summary,
        "bricks": lod.bricks(records, vpc), "octree": lod.octree(summary, n // vpc),
        "frame": points.sparkSession.createDataFrame([(float(n), float(vpc), [float(v) for v in frame.extent])], "n double, vpc double, extent array<double>"),
    }, frame


def map_problems(tables: Mapping[str, DataFrame], n: int, vpc: int) -> DataFrame:
    """Audits of written tables: one row per check that fails."""
    sizes = tables["voxels"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("voxels"))
    posted = tables["postings"].agg(F.count(F.lit(1)).alias("posted"), F.countDistinct("row_id").alias("distinct"))
    rooted = tables["octree"].filter(F.col("level") == F.lit(lod.tree_levels(n // vpc))).agg(F.coalesce(F.sum("n_points"), F.lit(0)).alias("rooted"))
    recorded = tables["records"].agg(F.count(F.lit(1)).alias("recorded"))
    placed = tables["points"].agg(F.count(F.lit(1)).alias("placed"))
    values = {k: v for df in (sizes, posted, rooted, recorded, placed) for k, v in df.first().asDict().items()}
    checks = {
        "rows of voxels": values["rows"] == values["placed"], "rows of postings": values["posted"] == values["placed"],
        "repeated postings": values["distinct"] == values["posted"], "records": values["recorded"] == values["voxels"], "octree root": values["rooted"] == values["placed"],
    }
    failed = [(k,) for k, ok in checks.items() if not ok]
    if not audits.audit_representatives(tables["records"], tables["postings"]).isEmpty():
        failed.append(("representatives",))
    if not audits.posting_order_violations(tables["postings"]).isEmpty():
        failed.append(("order of postings",))
    return tables["points"].sparkSession.createDataFrame(failed, "problem string")


def build_map(points: DataFrame, root: str, release: str, n: int, vpc: int, limit: int | None = None) -> dict[str, object]:
    """Build, write, audit and publish a map. A build that fails anywhere publishes nothing and leaves older releases as they are."""
    tables, _ = map_tables(points, n, vpc, limit)
    return publish_release(lambda: tables, lambda written: _refuse(map_problems(written, n, vpc), "audit failed"), root, release)
