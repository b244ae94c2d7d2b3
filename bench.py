"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "frame_3d", "assign_points", "representatives", "postings", "bricks", "octree", "density_pyramid_volume", "points_tiled", "lod_select",
    "spatial_rows", "nearest_rows", "nearest_rows_stored", "rows_in_radius", "voxels_in_sphere", "nearest_voxel", "dense_row_id", "collision_map", "one_to_one_join",
    "knn_exact", "ivf_search", "ivf_search_recall", "sq8_search", "int8_search", "project_head", "filter_counts", "mask_rows", "next_batch", "pack_offsets",
    "encode_urls", "audit_conservation", "latency_summary", "hourly_usage", "contract_diff",
)


VOLUME_ROWS, VOLUME_QUERIES = int(os.environ.get("BENCH_VOLUME_ROWS", "1000000")), 256
LISTS, PROBES, K = 64, 8, 24


def volume(spark) -> dict[str, object]:
    """Searches over a million vectors derived from the embeddings table; writing and training them is not timed.

    Exact search over rows and over stored blocks, and stored lists of codes with 8 of 64 lists probed, with and without rescoring.
    """
    import tempfile

    from pyspark.sql import functions as F

    from embedmap.operators import ann, blocks, vectors

    base = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    copies = -(-VOLUME_ROWS // base.count())
    moved = F.transform("embedding", lambda x, i: (x + F.sin(F.col("copy") * 7.0 + i) * 0.05).cast("float"))
    many = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        (F.col("vec_id") * copies + F.col("copy")).alias("row_id"), moved.alias("embedding"))
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    many.repartition(4 * int(CPUS)).write.parquet(f"{root}/base")
    rows = spark.read.parquet(f"{root}/base")
    rows.filter(F.col("row_id") % (rows.count() // VOLUME_QUERIES) == 1).select(F.col("row_id").alias("q"), "embedding").write.parquet(f"{root}/queries")
    queries = spark.read.parquet(f"{root}/queries")
    blocks.write(vectors.vector_blocks(rows), f"{root}/blocks")
    packed = spark.read.parquet(f"{root}/blocks")
    fit = rows.filter(F.pmod(F.xxhash64("row_id"), F.lit(50)) == 0)  # one in fifty rows fits the centroids
    model = ann.train_codes(rows, ann.ivf_train(fit, LISTS, seed=1, iterations=5))
    ann.write_lists(ann.code_blocks(rows, model), f"{root}/lists")
    lists, asked = ann.read_lists(spark, f"{root}/lists"), queries.count()
    out: dict[str, object] = {"rows": rows.count(), "dims": 64, "queries": asked}
    coded = lambda k: ann.search_lists(lists, model, queries, k, PROBES)
    searches = {
        "exact_rows": lambda: vectors.knn_exact(rows, queries, K), "exact_blocks": lambda: vectors.knn_blocks(packed, queries, K),
        f"codes_{PROBES}_of_{LISTS}": lambda: coded(K), f"codes_{PROBES}_of_{LISTS}_rescored": lambda: ann.refine(coded(2 * K), rows, queries, K)}
    found = {}
    for name, search in searches.items():
        start = time.perf_counter()
        hits = search().collect()  # K rows a query
        took = time.perf_counter() - start
        found[name] = {(r.q, r.row_id) for r in hits}
        out[name] = {"sec": round(took, 3), "ms_per_query": round(1000 * took / max(1, asked), 2), "values_per_sec": round(out["rows"] * 64 * asked / took),
                     "recall": round(len(found[name] & found["exact_rows"]) / max(1, len(found["exact_rows"])), 4)}
    return out


def main() -> None:
    from embedmap.plans.all import QUERIES
    from embedmap.session import get_session

    spark = get_session("bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    if sys.argv[1:] == ["volume"]:
        print(json.dumps(volume(spark)))
        return
    names = sys.argv[1:] or HEADLINE
    QUERIES["check_dense"](spark, SF).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF.rstrip("/")), "volume": volume(spark) if names == HEADLINE else None}))


if __name__ == "__main__":
    main()
