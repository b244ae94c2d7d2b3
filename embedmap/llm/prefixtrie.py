"""Prefix trie of conversations by union-find over the LCP edges of sorted neighbours.

A sequence is one binary key (16 bytes an element, so that byte order is the order of sequences) and the bytes of each element's text.
``prefix_trie`` range-partitions the sequences by key and id and builds the forest of each partition in its task: neighbours are
joined by edges of the length of their common prefix; edges are taken in descending depth; two components that an edge of depth d joins
become one below the node of that depth, so every merge creates (or widens) a branching node, and the elements between a
component and its merge are a chain of nodes with the component's members.

Nodes without a boundary conversation of their partition are final and returned at once. The others lie on the paths of the first and
last conversation; a partition's forest is contracted to these two paths, on which every node keeps the sums of all that is
closed below it. The contracted paths of ``FAN`` neighbouring partitions are merged by the same routine, and so on until one is left. Inside a
task the sequences go through in blocks, each contracted before the next, so that memory does not grow with the partition.

``rebuilt`` makes the sequences of conversations that begin with turns of a shared one. Defined cases: null role or text is empty;
a null turn comes first; equal turn numbers are ordered by role, then by the text's MD5, and repeated rows are turns of their own; rows
without a conv_id belong to no conversation and are left out; a conversation without turns belongs to the root; an empty table has no
nodes, not even a root; a conversation takes 16 bytes a turn in one row, whatever its texts' length; other columns
are not looked at. Turns are equal if role and text have equal 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from embedmap.llm.tables import small, stored

STEP = 16
#: Neighbouring partitions merged in one task of a round.
FAN = 256
#: Sequences that go through the union-find at once, and ids in one piece of a list that is digested.
BLOCK = 8192
PIECE = 1 << 15

NODE, PATH, DIGEST, LIST = range(4)
_PARTS = pa.list_(pa.struct([("depth", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("end", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]))
_OUT = pa.schema([
    ("kind", pa.int32()), ("conv", pa.int64()), ("depth", pa.int32()), ("parent", pa.int64()), ("parent_key", pa.binary()), ("node_key", pa.binary()),
    ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("end", pa.int64()),
    ("part", pa.int64()), ("place", pa.int32()), ("key", pa.binary()), ("sizes", pa.list_(pa.int32())), ("parts", _PARTS), ("said", pa.string())])
_SHAPE = T.StructType([T.StructField(f.name, from_arrow_type(f.type)) for f in _OUT])


def common(a: bytes, b: bytes) -> int:
    """Elements that two keys begin with in common."""
    n = min(len(a), len(b)) // STEP
    if a[:n * STEP] == b[:n * STEP]:
        return n
    low, high = 0, n  # a and b agree on low elements and not on high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid * STEP] == b[:mid * STEP] else (low, mid)
    return low


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Sums:
    """What is known of a node: members, smallest member, smallest member that ends there, children, leaves and saved tokens below it."""

    __slots__ = ("n", "least", "end", "children", "leaves", "saved")

    def __init__(self, n=0, least=None, end=None, children=0, leaves=0, saved=0):
        self.n, self.least, self.end, self.children, self.leaves, self.saved = n, least, end, children, leaves, saved

    def add(self, other: Sums) -> None:
        self.n += other.n
        self.least, self.end = _least(self.least, other.least), _least(self.end, other.end)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved


class Path:
    """A key, its elements' sizes, and what is closed or ends at its nodes by depth."""

    __slots__ = ("key", "sizes", "parts")

    def __init__(self, key: bytes, sizes: list[int], parts: dict[int, Sums]):
        self.key, self.sizes, self.parts = key, sizes, parts


class _Part:
    """Component of the union-find: sequences first..last, with the node of ``depth`` on top."""

    __slots__ = ("first", "last", "depth", "top", "waiting", "parts")

    def __init__(self, i: int, path: Path):
        self.first = self.last = i
        self.depth = len(path.sizes)
        self.parts = dict(path.parts)
        self.top = Sums()
        self.waiting: list[list] = []  # final children of the top node, whose parent isn't known yet
        own = self.parts.pop(self.depth, None)
        if own:
            self.top.add(own)


def forest(paths: list[Path], whole: bool) -> tuple[list[list], list[Path]]:
    """Final nodes and the paths (at most two) that the forest of sorted ``paths`` is contracted to; none if ``whole``.

    A node is [conv, depth, parent, parent_key, node_key, n, children, leaves, saved, end].
    """
    nodes: list[list] = []
    spines: tuple[dict, dict] = ({}, {})
    top, bottom = 0, len(paths) - 1
    parts = [_Part(i, p) for i, p in enumerate(paths)]
    up = list(range(len(paths)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def climb(c: _Part, depth: int) -> None:
        """Finish the component's nodes deeper than ``depth``."""
        path = paths[c.first]
        while c.depth > depth:
            s, key = c.top, path.key[:c.depth * STEP]
            c.depth -= 1
            above = Sums()
            if not whole and (c.first == top or c.last == bottom):
                spines[c.last == bottom][c.depth + 1] = s
                digest = hashlib.md5(key).digest() if c.waiting else None
                for node in c.waiting:
                    node[3] = digest
                c.waiting = []
            else:
                s.leaves = s.leaves if s.children else 1
                s.saved += (s.n - 1) * (path.sizes[c.depth] if c.depth >= 0 else 0)
                node = [s.least, c.depth + 1, None, None, key, s.n, s.children, s.leaves, s.saved, s.end]
                nodes.append(node)
                for child in c.waiting:
                    child[2] = s.least
                c.waiting = [node]
                above = Sums(s.n, s.least, None, 1, s.leaves, s.saved)
            own = c.parts.pop(c.depth, None)
            if own:
                above.add(own)
            c.top = above

    depths = [0, *(common(paths[i - 1].key, paths[i].key) for i in range(1, len(paths)))]
    for i in sorted(range(1, len(paths)), key=depths.__getitem__, reverse=True):
        x, y = parts[find(i - 1)], parts[find(i)]
        climb(x, depths[i])
        climb(y, depths[i])
        x.top.add(y.top)
        x.last = y.last
        small_, large = (x.waiting, y.waiting) if len(x.waiting) < len(y.waiting) else (y.waiting, x.waiting)
        large.extend(small_)
        x.waiting = large
        small_, large = (x.parts, y.parts) if len(x.parts) < len(y.parts) else (y.parts, x.parts)
        for depth, s in small_.items():
            if depth in large:
                large[depth].add(s)
            else:
                large[depth] = s
        x.parts = large
        # The smaller root keeps the component, as its first sequence names the path.
        parts[find(i)] = None
        up[find(i)] = find(i - 1)
    climb(parts[find(0)], -1)
    out = [] if whole else [Path(paths[k].key, paths[k].sizes, spines[k == bottom]) for k in sorted({top, bottom}) if k == bottom or spines[0]]
    return nodes, out


def _batch(kind: int, rows: list[list], names: tuple[str, ...]) -> pa.RecordBatch:
    n = len(rows)
    given = dict(zip(names, zip(*rows)))
    return pa.record_batch([pa.array([kind] * n, pa.int32()) if f.name == "kind" else pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


_NODE_NAMES = ("conv", "depth", "parent", "parent_key", "node_key", "n", "children", "leaves", "saved", "end")


def _node_rows(nodes: list[list], keyed: bool) -> pa.RecordBatch:
    for node in nodes:
        node[4] = hashlib.md5(node[4]).digest() if keyed else None
    return _batch(NODE, nodes, _NODE_NAMES)


def _path_rows(paths: list[Path], part: int) -> pa.RecordBatch:
    rows = [[part, i, p.key, p.sizes, [{"depth": d, **{c: getattr(s, c) for c in Sums.__slots__}} for d, s in p.parts.items()]] for i, p in enumerate(paths)]
    return _batch(PATH, rows, ("part", "place", "key", "sizes", "parts"))


class _Ends:
    """Ids of equal sequences, in ascending order: a digest where a run lies inside the partition, else pieces of the list."""

    def __init__(self):
        self.key, self.first, self.ids, self.open, self.done, self.pieces = None, None, [], True, [], []

    def take(self, key: bytes, conv: int) -> None:
        if key != self.key:
            if self.key is not None:
                self.close(self.open)
                self.open = False
            self.key, self.first, self.ids = key, conv, []
        self.ids.append(conv)
        if len(self.ids) >= PIECE:
            self._piece()
            self.open = True

    def _piece(self) -> None:
        self.pieces.append([hashlib.md5(self.key).digest(), self.ids[0], ",".join(map(str, self.ids))])
        self.ids = []

    def close(self, shared: bool) -> None:
        if shared and self.ids:
            self._piece()
        elif self.ids:
            self.done.append([self.first, hashlib.sha256(",".join(map(str, self.ids)).encode()).hexdigest()])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            yield _batch(DIGEST, self.done, ("end", "said"))
        if self.pieces:
            yield _batch(LIST, self.pieces, ("node_key", "end", "said"))
        self.done, self.pieces = [], []


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv, sizes, part) of one partition to final nodes, contracted paths and ends."""
    carried: list[Path] = []
    ends, part, last = _Ends(), None, None
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            s = b.slice(at, BLOCK)
            part = s.column(3)[0].as_py()
            paths = carried
            for key, conv, sizes in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), s.column(2)):
                ends.take(key, conv)
                if key == last:
                    paths[-1].parts.setdefault(len(key) // STEP, Sums()).add(Sums(1, conv, conv))
                else:
                    paths.append(Path(key, sizes.as_py(), {len(key) // STEP: Sums(1, conv, conv)}))
                    last = key
            nodes, carried = forest(paths, False)
            if nodes:
                yield _node_rows(nodes, False)
            yield from ends.rows()
    if part is not None:
        ends.close(True)
        yield from ends.rows()
        yield _path_rows(carried, part)


def _merged(whole: bool):
    """Contracted paths sorted by (group, part, place) to final nodes and the group's contracted paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, paths = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            nodes, left = forest(paths, whole)
            for at in range(0, len(nodes), 10_000):
                yield _node_rows(nodes[at:at + 10_000], True)
            if left:
                yield _path_rows(left, current)

        for b in batches:
            for group, key, sizes, parts in zip(*(b.column(c).to_pylist() for c in ("group", "key", "sizes", "parts"))):
                if group != current:
                    if paths:
                        yield from finish()
                    current, paths = group, []
                paths.append(Path(key, sizes, {p.pop("depth"): Sums(**p) for p in parts}))
        if paths:
            yield from finish()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists sorted by (list, first id) to the digest of each list, streamed."""
    current = first = digest = None
    out = []
    for b in batches:
        for key, end, said in zip(*(b.column(c).to_pylist() for c in range(3))):
            if key != current:
                if current is not None:
                    out.append((first, digest.hexdigest()))
                current, first, digest = key, end, hashlib.sha256()
                digest.update(said.encode())
            else:
                digest.update(f",{said}".encode())
    if current is not None:
        out.append((first, digest.hexdigest()))
    if out:
        yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["end", "said"])


def prefix_trie(sequences: DataFrame, partitions: int | None = None, fan: int = FAN) -> DataFrame:
    """Nodes of the trie of (conv long, key binary, sizes array<int>): (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), as described above; a node is named by its depth and its smallest member."""
    spark = sequences.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = sequences.select("key", "conv", "sizes").repartitionByRange(partitions, "key", "conv").sortWithinPartitions("key", "conv")
    local = stored(ordered.select("*", F.spark_partition_id().cast("long").alias("part")).mapInArrow(_local, _SHAPE))
    nodes, paths = local.filter(F.col("kind") == NODE), local.filter(F.col("kind") == PATH)
    late = None
    while True:
        groups = partitions = -(-partitions // fan)
        near = paths.select(F.expr(f"part div {fan}L").alias("group"), "part", "place", "key", "sizes", "parts")
        near = near.repartition(groups, "group").sortWithinPartitions("group", "part", "place")
        merged = stored(near.mapInArrow(_merged(groups == 1), _SHAPE))
        late = merged if late is None else late.unionByName(merged)
        if groups == 1:
            break
        paths = merged.filter(F.col("kind") == PATH)
    late = late.filter(F.col("kind") == NODE)
    # Parents that became final in a later round: at most two paths a partition, told by the digest of their prefix.
    names = small(late.select(F.col("node_key").alias("parent_key"), F.col("conv").alias("found")))
    nodes = nodes.unionByName(late)
    nodes = nodes.filter(F.col("parent_key").isNull()).unionByName(
        nodes.filter(F.col("parent_key").isNotNull()).drop("parent").join(names, "parent_key").withColumnRenamed("found", "parent"))
    lists = local.filter(F.col("kind") == LIST).select("node_key", "end", "said")
    long = lists.repartition("node_key").sortWithinPartitions("node_key", "end").mapInArrow(_joined, "end long, said string")
    ends = local.filter(F.col("kind") == DIGEST).select("end", "said").unionByName(long)
    columns = [F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
               F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")]
    none = nodes.filter(F.col("end").isNull()).select(*columns, F.lit(hashlib.sha256(b"").hexdigest()).alias("ends_sha256"))
    some = nodes.filter(F.col("end").isNotNull()).select("end", *columns).join(ends, "end").select(*none.columns[:-1], F.col("said").alias("ends_sha256"))
    return none.unionByName(some)


def _digest(role: Column, text: Column) -> Column:
    """128 bits of a turn; the role's length tells where it ends."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def rebuilt(conversations: DataFrame, every: int = 5, longest: int = 9) -> DataFrame:
    """(conv, key, sizes): conversation c as the first h turns of conversation c - c % ``every`` and its own turns after the first h, where h is
    the CRC-32 of c in decimal, modulo ``longest``. Texts are not shuffled, only their digests and lengths."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    # A null turn is told by the flag, so that it comes first whatever the numbers are.
    turn = F.struct(F.col("turn").isNotNull(), "turn", role, F.md5(text), _digest(role, text).alias("key"), F.octet_length(text).alias("size"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv")).agg(
        F.array_sort(F.collect_list(turn)).alias("t")).select("conv", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("t"))
    base = turns.filter(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("t", 1, longest - 1).alias("start"))
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % longest).cast("int")
    own = turns.withColumns({"base": F.col("conv") - F.col("conv") % every, "head": head})
    whole = own.join(base, "base", "left")
    rest = F.slice("t", F.col("head") + 1, F.greatest(F.size("t") - F.col("head"), F.lit(0)))
    whole = whole.select("conv", F.concat(F.when(F.col("start").isNull() | (F.col("head") == 0), F.slice("t", 1, 0)).otherwise(F.slice("start", F.lit(1), F.col("head"))), rest).alias("t"))
    return whole.select("conv", F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["key"])), "")).alias("key"), F.transform("t", lambda t: t["size"]).alias("sizes"))
