"""Inventory bookkeeping on the order map.

The event log is derived from the postings: every voxel is mined to half, rows of status F are returned, and rows of
status P behind the cursor are selected through a filter. A voxel whose whole first half returns resets in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from embedmap.operators import inventory, metadata, voxels
from embedmap.plans.data import G, GRID, VPC, assigned, table
from embedmap.plans.metadata_queries import matching
from embedmap.plans.registry import part, query
from embedmap.session import cut, ensure_checkpoint_dir
from embedmap.sources import inventory_csv

VOXEL = ["chunk_id", "local_id"]
N_CHUNKS = G**3


class Log:
    """Postings, voxels, the derived event log and its replayed state.

    Each is a stored table in practice (a published map, a saved inventory), so each is written once here too.
    """

    def __init__(self, spark, sf):
        placed = assigned(spark, sf)
        self.postings = cut(voxels.postings(placed))
        self.voxels = cut(voxels.representatives(placed, GRID))
        status = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"))
        df = self.postings.join(status, "row_id").join(self.voxels.select(*VOXEL, "n"), VOXEL)
        df = df.withColumn("c", F.expr("(n + 1) div 2"))
        df = cut(df)
        whole = df.groupBy(*VOXEL).agg(F.bool_and(F.when(F.col("pos") < F.col("c"), F.col("status") == "F")).alias("whole"))
        df = df.join(whole, VOXEL)
        event = lambda op, seq, cursor, cond: df.filter(cond).select(
            *VOXEL, "row_id", "pos", F.lit(op).alias("op"), seq.alias("seq"), cursor.cast("long").alias("cursor_after"))
        first = F.col("pos") < F.col("c")
        self.events = (
            event("extract", F.col("pos"), F.col("pos") + 1, first)
            .unionByName(event("return", F.col("n") + F.col("pos"), F.col("c"), first & (F.col("status") == "F")))
            .unionByName(event("extract", F.col("n") * 2 + F.col("pos"), F.when(F.col("whole"), 0).otherwise(F.col("c")),
                               ~first & (F.col("status") == "P")))
        )
        self.live = cut(inventory.replay(self.events))
        self.stacks = cut(inventory.stacks_of(self.live))
        self.rows = cut(inventory.rows_of(self.live, self.stacks))

    def saved(self):
        meta = self.voxels.select(*VOXEL, F.col("n").alias("total_points"), "repr_row_id")
        return self.stacks.join(meta, VOXEL)


part("led", """
SELECT post.*, o_orderstatus AS status, vox.n, (vox.n + 1) // 2 AS c, vox.repr_row_id,
  bool_and(CASE WHEN pos < (vox.n + 1) // 2 THEN o_orderstatus = 'F' END) OVER (PARTITION BY post.chunk_id, post.local_id) AS whole
FROM post JOIN vox ON vox.chunk_id = post.chunk_id AND vox.local_id = post.local_id JOIN orders ON o_orderkey = row_id""")
part("evt", """
SELECT chunk_id, local_id, row_id, pos, 'extract' AS op, pos AS seq, pos + 1 AS cursor_after FROM led WHERE pos < c
UNION ALL SELECT chunk_id, local_id, row_id, pos, 'return', n + pos, c FROM led WHERE pos < c AND status = 'F'
UNION ALL SELECT chunk_id, local_id, row_id, pos, 'extract', 2 * n + pos, CASE WHEN whole THEN 0 ELSE c END FROM led WHERE pos >= c AND status = 'P'""")
part("evr", "SELECT *, sum(CASE op WHEN 'extract' THEN 1 ELSE -1 END) OVER (PARTITION BY chunk_id, local_id ORDER BY seq) AS held_after FROM evt")
part("evl", """
SELECT * FROM (SELECT *, max(CASE WHEN held_after = 0 THEN seq END) OVER (PARTITION BY chunk_id, local_id) AS reset_at FROM evr)
WHERE reset_at IS NULL OR seq > reset_at""")
part("stk", """
SELECT chunk_id, local_id, max(cursor_after) AS cursor, min(seq) FILTER (op = 'extract') AS first_seq, max(seq) FILTER (op = 'extract') AS last_seq FROM evl GROUP BY 1, 2""")
part("rws", """
SELECT l.chunk_id, l.local_id, l.row_id, CASE l.op WHEN 'extract' THEN 'held' ELSE 'returned' END AS state, l.op = 'extract' AND l.pos >= s.cursor AS selected, l.seq
FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, local_id, row_id ORDER BY seq DESC) AS k FROM evl) l JOIN stk s ON s.chunk_id = l.chunk_id AND s.local_id = l.local_id
WHERE k = 1 AND (l.op = 'extract' OR l.pos < s.cursor)""")
part("sav", "SELECT stk.*, vox.n AS total_points, vox.repr_row_id FROM stk JOIN vox ON vox.chunk_id = stk.chunk_id AND vox.local_id = stk.local_id")


@query("replay_rows", "SELECT * FROM rws")
def replay_rows(spark, sf):
    return Log(spark, sf).rows


@query("replay_stacks", "SELECT * FROM stk")
def replay_stacks(spark, sf):
    return Log(spark, sf).stacks


@query("next_batch", """
WITH cand AS (SELECT chunk_id, local_id, row_id, 0 AS cls, seq AS ord FROM rws WHERE state = 'returned'
  UNION ALL SELECT p.chunk_id, p.local_id, p.row_id, 1, p.pos FROM post p LEFT JOIN stk s ON s.chunk_id = p.chunk_id AND s.local_id = p.local_id
  WHERE p.pos >= coalesce(s.cursor, 0) AND p.row_id NOT IN (SELECT row_id FROM rws WHERE selected))
SELECT chunk_id, local_id, row_id, take FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, local_id ORDER BY cls, ord, row_id) AS take FROM cand) WHERE take <= 3""")
def next_batch(spark, sf):
    log = Log(spark, sf)
    return inventory.next_batch(log.postings, log.rows, log.stacks, 3)


@query("next_batch_filtered", """
WITH cand AS (SELECT chunk_id, local_id, row_id, 0 AS cls, seq AS ord FROM rws WHERE state = 'returned' AND row_id IN (SELECT row_id FROM flt)
  UNION ALL SELECT chunk_id, local_id, row_id, 1, pos FROM post WHERE row_id IN (SELECT row_id FROM flt) AND row_id NOT IN (SELECT row_id FROM rws))
SELECT chunk_id, local_id, row_id, take FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, local_id ORDER BY cls, ord, row_id) AS take FROM cand) WHERE take <= 3""")
def next_batch_filtered(spark, sf):
    log = Log(spark, sf)
    return inventory.next_batch_filtered(log.postings, log.rows, matching(spark, sf), 3)


@query("drain_status", """
SELECT v.chunk_id, v.local_id, v.n AS total, count(r.row_id) AS extracted, least(1, count(r.row_id)::DOUBLE / greatest(1, v.n)) AS fraction, count(r.row_id) >= v.n AS complete
FROM vox v LEFT JOIN rws r ON r.chunk_id = v.chunk_id AND r.local_id = v.local_id AND r.state = 'held' GROUP BY 1, 2, 3""")
def drain_status(spark, sf):
    log = Log(spark, sf)
    return inventory.drain_status(log.voxels, log.rows)


@query("drain_status_filtered", """
WITH t AS (SELECT chunk_id, local_id, count(*) AS n FROM flt GROUP BY 1, 2),
e AS (SELECT chunk_id, local_id, count(*) AS n FROM rws WHERE state = 'held' AND row_id IN (SELECT row_id FROM flt) GROUP BY 1, 2)
SELECT v.chunk_id, v.local_id, coalesce(t.n, 0) AS total, coalesce(e.n, 0) AS extracted,
  least(1, coalesce(e.n, 0)::DOUBLE / greatest(1, coalesce(t.n, 0))) AS fraction, coalesce(e.n, 0) >= coalesce(t.n, 0) AS complete
FROM vox v LEFT JOIN t USING (chunk_id, local_id) LEFT JOIN e USING (chunk_id, local_id)""")
def drain_status_filtered(spark, sf):
    log = Log(spark, sf)
    return inventory.drain_status(log.voxels, log.rows, log.postings, matching(spark, sf))


@query("validate_inventory", """
SELECT chunk_id, local_id, -1::BIGINT AS row_id, 'representative' AS problem FROM sav WHERE repr_row_id >= 10000
UNION ALL SELECT s.chunk_id, s.local_id, -1, 'arithmetic' FROM sav s JOIN rws r ON r.chunk_id = s.chunk_id AND r.local_id = s.local_id
  WHERE s.chunk_id = 5 GROUP BY s.chunk_id, s.local_id, s.cursor HAVING count(*) <> s.cursor + 1 + count(*) FILTER (selected)
UNION ALL SELECT -1, -1, row_id, 'duplicate or invalid row' FROM rws WHERE row_id >= 10000
UNION ALL SELECT chunk_id, local_id, -1, 'cursor' FROM sav WHERE chunk_id = 5 AND cursor + 1 > total_points""")
def validate_inventory(spark, sf):
    """A save with a smaller map than its rows need and a wrong cursor in one chunk."""
    log = Log(spark, sf)
    broken = log.saved().withColumn("cursor", F.when(F.col("chunk_id") == 5, F.col("cursor") + 1).otherwise(F.col("cursor")))
    return inventory.validate_inventory(broken, log.rows, 10000, N_CHUNKS, VPC)


@query("verify_prefix", """
SELECT p.chunk_id, p.local_id, p.row_id, 'missing from save' AS problem FROM post p JOIN stk s ON s.chunk_id = p.chunk_id AND s.local_id = p.local_id
WHERE p.pos < s.cursor AND s.chunk_id = 7 AND p.row_id % 5 = 0
UNION ALL SELECT chunk_id, local_id, -1, 'block metadata' FROM sav WHERE chunk_id = 9""")
def verify_prefix(spark, sf):
    """Rows are missing in one chunk, counts are wrong in another."""
    log = Log(spark, sf)
    rows = log.rows.filter(~((F.col("chunk_id") == 7) & (F.col("row_id") % 5 == 0) & ~F.col("selected")))
    saved = log.saved().withColumn("total_points", F.when(F.col("chunk_id") == 9, F.col("total_points") + 1).otherwise(F.col("total_points")))
    return inventory.verify_prefix(saved, rows, log.postings, log.voxels)


@query("collect_hits", """
SELECT f.row_id, CASE WHEN f.row_id % 4 = 0 THEN 0 ELSE f.chunk_id END AS chunk_id, f.local_id, f.row_id % 4 <> 0 OR f.chunk_id = 0 AS valid,
  coalesce(v.n, -1) AS total_points, coalesce(v.repr_row_id, -1) AS repr_row_id
FROM flt f LEFT JOIN vox v ON v.chunk_id = CASE WHEN f.row_id % 4 = 0 THEN 0 ELSE f.chunk_id END AND v.local_id = f.local_id""")
def collect_hits(spark, sf):
    placed = assigned(spark, sf)
    claimed = F.when(F.col("row_id") % 4 == 0, F.lit(0).cast("long")).otherwise(F.col("chunk_id"))
    hits = matching(spark, sf).select("row_id", claimed.alias("chunk_id"), "local_id")
    return inventory.collect_hits(hits, placed, voxels.representatives(placed, GRID)).na.fill(-1, ["total_points", "repr_row_id"])


@query("inventory_page", "SELECT chunk_id, local_id, cursor, first_seq, last_seq FROM stk ORDER BY last_seq DESC, chunk_id, local_id LIMIT 25 OFFSET 50")
def inventory_page(spark, sf):
    return inventory.inventory_page(Log(spark, sf).stacks, 2, 25)


@query("inventory_rows_page", """
WITH b AS (SELECT * FROM stk ORDER BY last_seq DESC, chunk_id, local_id LIMIT 25)
SELECT chunk_id, local_id, row_id, rank FROM (SELECT r.*, row_number() OVER (PARTITION BY r.chunk_id, r.local_id ORDER BY r.seq DESC, r.row_id) AS rank
  FROM rws r JOIN b ON b.chunk_id = r.chunk_id AND b.local_id = r.local_id WHERE state = 'held') WHERE rank > 2 AND rank <= 4""")
def inventory_rows_page(spark, sf):
    log = Log(spark, sf)
    return inventory.inventory_rows_page(log.rows, inventory.inventory_page(log.stacks, 0, 25), 1, 2)


def csv(spark, sf):
    log = Log(spark, sf)
    urls = log.postings.select("row_id", F.concat(F.lit("https://host/"), F.col("row_id").cast("string")).alias("url"))
    return inventory_csv.inventory_to_csv(log.saved(), log.rows, urls, "orders", "pack-a")


part("csvl", """
SELECT r.*, row_number() OVER (PARTITION BY chunk_id, local_id ORDER BY seq, row_id) - 1 AS line FROM rws r WHERE state = 'held'""")


@query("inventory_to_csv", """
WITH q AS (SELECT chunk_id, local_id, coalesce(string_agg(CAST(row_id AS VARCHAR), ';' ORDER BY seq) FILTER (state = 'returned'), '') AS back,
  coalesce(string_agg(CAST(row_id AS VARCHAR), ';' ORDER BY seq) FILTER (selected), '') AS sel FROM rws GROUP BY 1, 2)
SELECT '1' AS version, 'orders' AS dataset, 'pack-a' AS pack, CAST(l.chunk_id AS VARCHAR) AS chunk_id, CAST(l.local_id AS VARCHAR) AS voxel_id,
  CAST(l.row_id AS VARCHAR) AS row_id, 'https://host/' || l.row_id AS thumbnail_url, line, """ + ", ".join(
    f"CASE WHEN line = 0 THEN CAST({e} AS VARCHAR) ELSE '' END AS {n}" for n, e in (
        ("total_points", "s.total_points"), ("repr_row_id", "s.repr_row_id"), ("cursor", "s.cursor"), ("returned_row_ids", "q.back"),
        ("first_extracted_at", "s.first_seq"), ("last_extracted_at", "s.last_seq"), ("selected_row_ids", "q.sel"))) + """
FROM csvl l JOIN sav s ON s.chunk_id = l.chunk_id AND s.local_id = l.local_id JOIN q ON q.chunk_id = l.chunk_id AND q.local_id = l.local_id""")
def inventory_to_csv(spark, sf):
    return csv(spark, sf)


@query("inventory_from_csv", "SELECT chunk_id, local_id, row_id, state, selected FROM rws WHERE (chunk_id, local_id) IN (SELECT (chunk_id, local_id) FROM csvl)")
def inventory_from_csv(spark, sf):
    """Reading back what was exported gives the same rows."""
    _, rows = inventory_csv.inventory_from_csv(csv(spark, sf))
    return rows.select("chunk_id", "local_id", "row_id", "state", "selected")


@query("inventory_csv_files", "SELECT chunk_id, local_id, row_id, state, selected FROM rws WHERE (chunk_id, local_id) IN (SELECT (chunk_id, local_id) FROM csvl)")
def inventory_csv_files(spark, sf):
    """The same through files: written, read in byte ranges, checked and taken apart."""
    path = f"{ensure_checkpoint_dir(spark)}/inventory-{uuid.uuid4().hex}"
    inventory_csv.write_inventory_csv(csv(spark, sf), path)
    _, rows = inventory_csv.inventory_from_csv(inventory_csv.read_inventory_csv(spark, path))
    return rows.select("chunk_id", "local_id", "row_id", "state", "selected")
