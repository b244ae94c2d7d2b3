"""Density pyramid, tiles, level of detail and spatial queries on the event points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from embedmap.functions import grid
from embedmap.operators import frames, minimap, pages
from embedmap.operators.ordering import md5_priority
from embedmap.plans.data import CORPORA, ZOOM, assigned, frame2, points2, quantized, table
from embedmap.plans.frame_queries import edges, sql_edges
from embedmap.plans.registry import part, query
from embedmap.session import ensure_checkpoint_dir

E2 = ["x0", "x1", "y0", "y1"]


@query("frame_2d", sql_edges("f2", E2))
def frame_2d(spark, sf):
    return edges(spark, frame2(spark, sf).extent, E2)


@query("quantize", "SELECT row_id, corpus, qx, qy FROM z2")
def quantize(spark, sf):
    return quantized(spark, sf)


@query("dequantize", """
SELECT row_id, round(x0 + (qx + 0.5::DOUBLE) / 65536 * (x1 - x0), 9) AS dx, round(y1 - (qy + 0.5::DOUBLE) / 65536 * (y1 - y0), 9) AS dy FROM z2, f2""")
def dequantize(spark, sf):
    f = frame2(spark, sf)
    out = frames.dequantize(frames.quantize(points2(spark, sf), f), f)
    return out.select("row_id", F.round("dx", 9).alias("dx"), F.round("dy", 9).alias("dy"))


@query("bins_at", "SELECT row_id, bin_x, bin_y FROM b2")
def bins_at(spark, sf):
    return quantized(spark, sf).select("row_id", grid.bins_at(F.col("qx"), ZOOM).alias("bin_x"), grid.bins_at(F.col("qy"), ZOOM).alias("bin_y"))


@query("tile_sort_key", "SELECT row_id, tile * 65536 + morton AS sort_key FROM t2")
def tile_sort_key(spark, sf):
    return quantized(spark, sf).select("row_id", grid.tile_sort_key(F.col("qx"), F.col("qy"), ZOOM).alias("sort_key"))


@query("density_finest", "SELECT corpus, bin_x, bin_y, count(*) AS n FROM b2 GROUP BY 1, 2, 3")
def density_finest(spark, sf):
    return minimap.density_finest(quantized(spark, sf), ZOOM)


def pyramid(spark, sf):
    return minimap.density_pyramid(minimap.density_finest(quantized(spark, sf), ZOOM), ZOOM)


@query("density_pyramid", "SELECT * FROM pyr")
def density_pyramid(spark, sf):
    return pyramid(spark, sf)


# Volume: line items by price and discount; no row identity needed.
@query("density_pyramid_volume", """
WITH v AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT AS corpus,
  CAST(least(greatest(floor(l_extendedprice / 120000 * 65536), 0), 65535) AS BIGINT) AS qx,
  CAST(least(greatest(floor((51 - l_quantity) / 51 * 65536), 0), 65535) AS BIGINT) AS qy FROM lineitem)
SELECT CAST(z AS BIGINT) AS z, corpus, qx >> (8 - z) AS bin_x, qy >> (8 - z) AS bin_y, count(*) AS n
FROM v, (SELECT unnest(range(6)) AS z) GROUP BY 1, 2, 3, 4""")
def density_pyramid_volume(spark, sf):
    frame = frames.Frame([0.0, 120000.0, 0.0, 51.0], [0.0, 120000.0, 0.0, 51.0])
    corpus = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    points = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), corpus.alias("corpus"))
    return minimap.density_pyramid(minimap.density_finest(frames.quantize(points, frame), 5), 5)


@query("tile_index", """
SELECT z, bin_y >> 8 AS ty, bin_x >> 8 AS tx, CAST(sum(n) AS BIGINT) AS n, list_sort(list(DISTINCT corpus)) AS corpora FROM pyr GROUP BY 1, 2, 3""")
def tile_index(spark, sf):
    return minimap.tile_index(pyramid(spark, sf))


@query("level_index", """
SELECT z, round(ln(1 + max(n)), 9) AS log_peak, CAST(sum(n) AS BIGINT) AS total, first(t) AS tiles_written, first(p) AS planes_written
FROM (SELECT z, bin_y, bin_x, sum(n) AS n FROM pyr GROUP BY 1, 2, 3)
JOIN (SELECT z, count(DISTINCT (bin_y >> 8, bin_x >> 8)) AS t, count(DISTINCT (bin_y >> 8, bin_x >> 8, corpus)) AS p FROM pyr GROUP BY 1) USING (z) GROUP BY z""")
def level_index(spark, sf):
    return minimap.level_index(pyramid(spark, sf)).withColumn("log_peak", F.round("log_peak", 9))


@query("overview_density", "SELECT qx >> 7 AS bin_x, qy >> 7 AS bin_y, count(*) AS n FROM z2 GROUP BY 1, 2")
def overview_density(spark, sf):
    return minimap.overview_density(quantized(spark, sf))


@query("overview_stats", """
SELECT count(*) AS occupied_bins, max(n) AS max_bin, CAST(sum(n) AS BIGINT) AS total, sum(n) = (SELECT count(*) FROM events) AS conserved
FROM (SELECT count(*) AS n FROM z2 GROUP BY qx >> 7, qy >> 7)""")
def overview_stats(spark, sf):
    return minimap.overview_stats(minimap.overview_density(quantized(spark, sf)), table(spark, sf, "events").count())


def tiled(spark, sf):
    return minimap.points_tiled(quantized(spark, sf), ZOOM)


@query("points_tiled", "SELECT pos, tile, qx, qy, corpus, row_id FROM til")
def points_tiled(spark, sf):
    return tiled(spark, sf)


@query("packed_points", "SELECT pos, tile, qx, qy, corpus * 268435456 + row_id AS packed FROM til")
def packed_points(spark, sf):
    return minimap.packed_points(tiled(spark, sf))


@query("tile_offsets", f"""
SELECT i AS tile, 8 * (SELECT count(*) FROM t2 WHERE tile < i) AS byte_offset FROM range({4 ** ZOOM + 1}) t(i)""")
def tile_offsets(spark, sf):
    return minimap.tile_offsets(quantized(spark, sf), ZOOM)


@query("corpus_counts", """
SELECT m.name, m.corpus, count(row_id) AS n FROM (VALUES """ + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in {**CORPORA, "none": 5}.items()) +
       ") m(name, corpus) LEFT JOIN z2 USING (corpus) GROUP BY 1, 2")
def corpus_counts(spark, sf):
    return minimap.corpus_counts(quantized(spark, sf), {**CORPORA, "none": 5})


@query("rank_within", """
SELECT row_id, row_number() OVER (PARTITION BY corpus, qx >> 12 ORDER BY md5('5:' || row_id), row_id) - 1 AS rank FROM z2""")
def rank_within(spark, sf):
    q = quantized(spark, sf).withColumn("cell", F.shiftright("qx", 12)).withColumn("prio", md5_priority(5, "row_id"))
    return minimap.rank_within(q, ["corpus", "cell"], "prio").select("row_id", "rank")


@query("cap_for_budget", """
SELECT max(c) AS cap FROM range(1, (SELECT max(n) + 1 FROM (SELECT count(*) AS n FROM b2 GROUP BY bin_x // 16, bin_y // 16))) t(c)
WHERE (SELECT sum(least(n, c)) FROM (SELECT count(*) AS n FROM b2 GROUP BY bin_x // 16, bin_y // 16)) <= (SELECT count(*) // 2 FROM b2)""")
def cap_for_budget(spark, sf):
    q = quantized(spark, sf)
    counts = q.groupBy(F.shiftright("qx", 12 - ZOOM).alias("cx"), F.shiftright("qy", 12 - ZOOM).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    return minimap.cap_for_budget(counts, F.lit(q.count() // 2))


LOD_LIMIT = 2_000_000
part("bud", f"SELECT least(count(*) // 4, {LOD_LIMIT}) AS budget FROM z2")
part("occ", "SELECT z, bin_x, bin_y, CAST(sum(n) AS BIGINT) AS n FROM pyr GROUP BY 1, 2, 3")
part("stz", "SELECT coalesce(max(z), 0) AS s FROM (SELECT z, count(*) AS bins FROM occ GROUP BY 1), bud WHERE bins <= budget")
part("capt", """
SELECT greatest(coalesce(max(c), 1), 1) AS cap FROM (
  SELECT c, sum(least(n, c)) AS got FROM (SELECT n FROM occ, stz WHERE z = s),
         (SELECT unnest(range(1, (SELECT max(n) + 1 FROM occ, stz WHERE z = s))) AS c) GROUP BY c), bud WHERE got <= budget""")
part("rnk", """
SELECT z2.*, md5('11:' || row_id) AS prio, row_number() OVER (
  PARTITION BY qx >> (8 - s), qy >> (8 - s) ORDER BY md5('11:' || row_id), row_id) - 1 AS rank FROM z2, stz""")
part("lsel", "SELECT row_id, corpus, qx, qy, prio FROM (SELECT rnk.*, row_number() OVER (ORDER BY rank, prio, row_id) AS o FROM rnk, capt WHERE rank < cap), bud WHERE o <= budget")


def selected(spark, sf):
    q = quantized(spark, sf)
    n = q.count()
    return minimap.lod_select(q, ZOOM, 11, n, LOD_LIMIT), minimap.lod_budget(n, LOD_LIMIT)


@query("lod_select", "SELECT * FROM lsel")
def lod_select(spark, sf):
    return selected(spark, sf)[0]


for _z in range(ZOOM):
    part(f"lc{_z}", f"""
SELECT greatest(coalesce(max(c), 1), 1) AS cap FROM (SELECT c, sum(least(n, c)) AS got
  FROM (SELECT count(*) AS n FROM lsel GROUP BY qx >> {8 - _z}, qy >> {8 - _z}),
       (SELECT unnest(range(1, (SELECT max(n) + 1 FROM (SELECT count(*) AS n FROM lsel GROUP BY qx >> {8 - _z}, qy >> {8 - _z})))) AS c)
  GROUP BY c), bud
WHERE got <= greatest(1, budget // {4 ** (ZOOM - _z)})""")
part("lcaps", f"SELECT {', '.join('greatest(' + ', '.join(f'(SELECT cap FROM lc{y})' for y in range(z + 1)) + f') AS cap{z}' for z in range(ZOOM))}")
part("lmin", "SELECT row_id, corpus, qx, qy, prio, CASE " + " ".join(
    f"WHEN r{z} < cap{z} THEN {z}" for z in range(ZOOM)) + f" ELSE {ZOOM} END::BIGINT AS min_zoom FROM (SELECT *, " + ", ".join(
    f"row_number() OVER (PARTITION BY qx >> {8 - z}, qy >> {8 - z} ORDER BY prio, row_id) - 1 AS r{z}" for z in range(ZOOM)) + " FROM lsel), lcaps")


@query("lod_min_zoom", "SELECT * FROM lmin")
def lod_min_zoom(spark, sf):
    sel, budget = selected(spark, sf)
    return minimap.lod_min_zoom(sel, ZOOM, budget)


@query("lod_offsets", f"""
SELECT i AS min_zoom, (SELECT count(*) FROM lmin WHERE min_zoom = i) AS n, 9 * (SELECT count(*) FROM lmin WHERE min_zoom < i) AS byte_offset
FROM range({ZOOM + 2}) t(i)""")
def lod_offsets(spark, sf):
    sel, budget = selected(spark, sf)
    return minimap.lod_offsets(minimap.lod_min_zoom(sel, ZOOM, budget), ZOOM)


# Events and orders share row ids 0..; the voxel address of an event is that of the order with its id.
part("spat", "SELECT pos, qx, qy, til.row_id, corpus, a3.chunk_id, a3.local_id FROM til JOIN a3 USING (row_id)")


def spatial(spark, sf):
    return minimap.spatial_rows(tiled(spark, sf), assigned(spark, sf))


@query("spatial_rows", "SELECT * FROM spat")
def spatial_rows(spark, sf):
    return spatial(spark, sf)


@query("spatial_pages", """
SELECT pos // 512 AS page, min(pos) AS start, count(*) AS n, min(qx) AS x0, min(qy) AS y0, max(qx) AS x1, max(qy) AS y1
FROM til GROUP BY 1""")
def spatial_pages(spark, sf):
    return minimap.spatial_pages(tiled(spark, sf), 512)


# Query positions: one per supplier, also outside the occupied part.
part("qpos", "SELECT s_suppkey AS q, CAST((s_suppkey * 7919) % 65536 AS BIGINT) AS qx, CAST((s_nationkey * 2621) % 65536 AS BIGINT) AS qy FROM supplier")


def positions(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("q"), (F.col("s_suppkey") * 7919 % 65536).alias("qx"),
        (F.col("s_nationkey").cast("long") * 2621 % 65536).alias("qy"))


part("qd2", "SELECT q, row_id, CAST((a.qx - b.qx) * (a.qx - b.qx) + (a.qy - b.qy) * (a.qy - b.qy) AS DOUBLE) AS d2 FROM z2 a, qpos b")


@query("nearest_rows", """
SELECT q, d2, row_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, row_id) AS k FROM qd2) WHERE k = 1""")
def nearest_rows(spark, sf):
    return minimap.nearest_rows(quantized(spark, sf), positions(spark, sf))


@query("rows_in_radius", "SELECT q, row_id, d2 FROM qd2 WHERE d2 <= 3000 * 3000")
def rows_in_radius(spark, sf):
    return minimap.rows_in_radius(quantized(spark, sf), positions(spark, sf), 3000)


@query("rows_in_radius_capped", """
SELECT q, row_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, row_id) AS k FROM qd2 WHERE d2 <= 3000 * 3000) WHERE k <= 16""")
def rows_in_radius_capped(spark, sf):
    return minimap.rows_in_radius(quantized(spark, sf), positions(spark, sf), 3000, 16)


def page_store(spark, sf, size=512):
    """The tiled points, written as pages and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    pages.write_pages(tiled(spark, sf), path, size)
    return pages.read_pages(spark, path, size)


@query("nearest_rows_stored", """
SELECT q, d2, row_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, row_id) AS k FROM qd2) WHERE k = 1""")
def nearest_rows_stored(spark, sf):
    """Nearest row of every position, from the stored pages whose boxes allow it."""
    return pages.search_pages(page_store(spark, sf), positions(spark, sf), cap=1)


@query("rows_in_radius_stored", "SELECT q, row_id, d2 FROM qd2 WHERE d2 <= 3000 * 3000")
def rows_in_radius_stored(spark, sf):
    return pages.search_pages(page_store(spark, sf), positions(spark, sf), radius=3000)


@query("rows_in_radius_capped_stored", """
SELECT q, row_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, row_id) AS k FROM qd2 WHERE d2 <= 3000 * 3000) WHERE k <= 16""")
def rows_in_radius_capped_stored(spark, sf):
    """The cap bounds the boxes before any row is read."""
    return pages.search_pages(page_store(spark, sf), positions(spark, sf), radius=3000, cap=16)


@query("voxels_in_radius", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, chunk_id, local_id) AS rank FROM (
  SELECT q, chunk_id, local_id, count(*) AS n FROM qd2 JOIN a3 USING (row_id) WHERE qd2.d2 <= 3000 * 3000 GROUP BY 1, 2, 3))""")
def voxels_in_radius(spark, sf):
    return minimap.voxels_in_radius(spatial(spark, sf), positions(spark, sf), 3000)


@query("validate_minimap", """
WITH c AS (SELECT count(*) AS n FROM events)
SELECT 'points' AS name, n AS actual, n AS expected, true AS ok FROM c UNION ALL SELECT 'offsets end', n, n, true FROM c
UNION ALL SELECT 'level ' || z, CAST(sum(pyr.n) AS BIGINT), c.n, true FROM pyr, c GROUP BY z, c.n""")
def validate_minimap(spark, sf):
    q = quantized(spark, sf)
    return minimap.validate_minimap(q, pyramid(spark, sf), minimap.tile_offsets(q, ZOOM), q.count())
