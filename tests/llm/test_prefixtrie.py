"""Prefix trie of conversations against a plain one."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from embedmap.llm import prefixtrie, queries, registry
from tests.llm import plain

SF = "/root/testdata/sf0.001"
SHAPE = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                      *[T.StructField(c, T.StringType()) for c in ("key", "conv", "sizes", "t", "base", "head", "part", "kind")]])


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", plain.hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    said = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(said.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + said[c][h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return plain.order(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node],
         plain.sha(",".join(str(c) for c in sorted(m) if whole[c] == node))) for node, m in members.items())


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if r.random() < 0.1:
            continue
        for turn in range(r.choice([0, 1, 2, 3, 4, 6, 9, 12])):
            rows.append((c * r.choice([1, 1, 1, 3]), turn, r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", None, "long " * 3])))
    rows += [(5, None, "user", "first"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (None, 1, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed,n,parts,fan,block,piece", [(1, 40, 1, 256, 8192, 1 << 15), (2, 150, 7, 2, 5, 3), (3, 300, 9, 3, 1, 1), (4, 200, 13, 256, 50, 4)])
def test_against_plain_version(spark, monkeypatch, seed, n, parts, fan, block, piece):
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    monkeypatch.setattr(prefixtrie, "PIECE", piece)
    rows = conversations(seed, n)
    if seed == 4:  # one conversation makes a third of all
        rows += [(1000 + c, t, "user", "same") for c in range(100) for t in range(12)]
    df = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SHAPE)
    got = prefixtrie.prefix_trie(prefixtrie.rebuilt(df), parts, fan).collect()
    assert plain.order(map(tuple, got)) == expected(rows)


def test_forest_contracts_to_two_paths():
    keys = sorted({b"".join(bytes([x]) * 16 for x in (k % 3, k % 5, k % 7)) for k in range(100)})
    paths = [prefixtrie.Path(k, [1, 1, 1], {3: prefixtrie.Sums(1, i, i)}) for i, k in enumerate(keys)]
    nodes, left = prefixtrie.forest(paths, False)
    assert len(left) == 2 and {p.key for p in left} == {keys[0], keys[-1]}
    rest, none = prefixtrie.forest(left, True)
    assert not none and len(nodes) + len(rest) == 1 + len({k[:16] for k in keys}) + len({k[:32] for k in keys}) + len(keys)
    assert next(n for n in rest if n[1] == 0)[5] == len(keys)


def test_empty_table(spark, scratch):
    spark.read.parquet(f"{SF}/conversations.parquet").limit(0).write.parquet(f"{scratch}/conversations.parquet")
    assert queries.TRIE_SQL and registry.QUERIES["op12_prefix_trie"](spark, scratch).count() == 0
