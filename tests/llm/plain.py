"""Plain Python versions of the operators, and small messy tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

SPACE = r"[\x20\x09-\x0D]+"
SHAPE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("key", "doc", "sig", "pos", "id", "host", "rule", "tokens", "anchor", "class")]])


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, n):
    """n words of invented text that depend on the seed only."""
    return [hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[: 3 + (i * 7 + seed) % 6] for i in range(n)]


def documents(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names an implementation might use itself."""
    return spark.createDataFrame([(d, t, s, None if t is None else len(t), *["x"] * 10) for d, t, s in rows], SHAPE)


def messy(spark):
    """Nulls, blanks, repeated rows, copies, near copies, shared lines and a long text."""
    a, b, long = prose(1, 120), prose(2, 90), prose(3, 30_000)
    near = a[:60] + ["changed"] + a[61:]
    shared = "This line is shared by Many documents"
    rows = [
        (1, " ".join(a), "s0"), (2, " ".join(a), "s0"), (3, " ".join(near), "s0"), (4, None, None), (5, "", "s1"), (6, " \n\t ", "s1"),
        (7, "\n".join([shared, " ".join(b[:20]), shared]), "s1"), (8, f"{shared.upper()}  \n{' '.join(b)}\n", "s2"), (9, f"\t{shared}\n\nend", "s2"),
        (10, " ".join(long), "s0"), (11, " ".join(["tail"] * 3 + long[200:400]), "s0"), (12, "one two", "s2"), (13, "One  two", "s2"), (14, "é È straße " * 12, "s3"),
        (None, " ".join(prose(5, 60)), "s3"), (15, " ".join(b), ""), (15, " ".join(b), ""), (16, "a b " * 40, "s0")]
    return rows, documents(spark, rows)


def line_dedup(rows, least=20, docs=3):
    holders = defaultdict(set)
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    name = lambda d: float("-inf") if d is None else d
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(name(d))
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        stays = [x for x in lines if len(holders[key(x)]) < docs or max(holders[key(x)]) == name(d)]
        out.append((d, len(lines), len(lines) - len(stays), sha("\n".join(stays))))
    return out


def shingles(text, width):
    w = words(lowered(text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def near_classes(rows, width, percent):
    """Component of every id (rows without an id apart)."""
    sets = [(d, shingles(t, width)) for d, t, _ in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        for g in s:
            index[g].append(i)
    for i, (d, s) in enumerate(sets):
        for j, n in Counter(j for g in s for j in index[g] if j < i).items():
            e, t = sets[j]
            if d is not None and e is not None and 100 * n >= percent * (len(s) + len(t) - n):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return [(d, len(s), d if d is None else find(d)) for d, s in sets]


def remove_repeats(rows, window=35):
    cut = [(d, words(t)) for d, t, _ in rows]
    seen = Counter(tuple(w[i:i + window]) for _, w in cut for i in range(len(w) - window + 1))
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
    full = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(again),
            len(w) < 20 or 100 * len(again) > 30 * len(w))


def order(rows):
    return sorted(rows, key=str)
