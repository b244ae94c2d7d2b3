"""Near-duplicate classes by banded MinHash with odd sketches.

A text's set are its distinct shingles of ``width`` words (A-Z lower-cased); texts with one set are one node. Each node has 120
MinHash samples. 30 bands of 4 samples bring nodes together; a pair with the wanted similarity shares no band with a
probability below 2e-7 at 0.8 and 3e-10 at 0.85. The samples, folded into 512 parity bits, form the odd sketch: the XOR of two
sketches counts how many samples differ, and so estimates a high similarity before any text is looked at. A pair is a link only
if the full sets confirm it.

Within a band's bucket every node is first compared with the smallest one, which costs one comparison per copy. What is still
apart after that meets in blocks inside tasks: nodes outside the smallest node's class meet each other and that class, while the
class doesn't meet itself. Sketches and sizes tell which nodes could be linked; their connections form families, and the blocks of a
family meet once more with the full sets, which are compared pair by pair until everything that is linked is in one class.
Tasks hand on one link per joined node, not pairs, and full sets travel once per meeting, so a group of copies or near copies of
any size is spread over tasks and no link between classes is lost.

Defined cases: null and blank texts have no shingles and are linked with nothing; so are rows with a null id; a text with fewer
words than a shingle is one shingle; texts with equal sets are linked; rows that share an id but not a text are classed by their
texts, so an id can be in two classes; an empty table gives no rows; other columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedmap.llm.components import components
from embedmap.llm.tables import stored
from embedmap.llm.words import BASE, mix, rolling, signed, slices, texts, word_hashes

BANDS, ROWS = 30, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Standard deviations of the estimate that a pair may lie below the threshold and still be compared in full.
MARGIN = 4.5
#: Nodes of one side that meet in one task at a time.
BLOCK = 256

_SHAPE = "doc_id long, n_shingles long, hi long, lo long, bands array<long>, sketch array<long>"


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, bounds = word_hashes(pc.ascii_lower(column))
    grams = mix(rolling(h, width))
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start >= width:
            yield np.unique(grams[start:end - width + 1])
        elif end > start:
            yield np.array([xxhash.xxh3_64_intdigest(h[start:end].tobytes(), seed=end - start)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES x texts smallest values under SAMPLES bijections of 32 bits."""
    rng = np.random.default_rng(20)
    shift, factor = rng.integers(0, 1 << 32, SAMPLES, np.uint32), rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((SAMPLES, len(sets)), np.uint32)
    for k in range(SAMPLES):
        v = (x ^ shift[k]) * factor[k]
        out[k] = np.minimum.reduceat(v ^ (v >> np.uint32(15)), starts)
    return out


def _band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.empty((samples.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(samples.shape[1], b + 1, np.uint64)
        for row in samples[b * ROWS:(b + 1) * ROWS]:
            key = mix(key * BASE + row)
        keys[:, b] = key
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """texts x 8 words: bit i is the parity of the number of samples that fall on it."""
    n = samples.shape[1]
    place = mix((np.arange(SAMPLES, dtype=np.uint64)[:, None] << np.uint64(32)) | samples) % np.uint64(SKETCH_BITS)
    at = place.astype(np.int64) + SKETCH_BITS * np.arange(n)
    parity = (np.bincount(at.ravel(), minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)


def most_bits(threshold: float) -> int:
    """Largest XOR count of two sketches at which their texts can reach the threshold."""
    least = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / SAMPLES)
    differing = 2 * SAMPLES * (1 - least)
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing))


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in slices(texts(b.column(1))):
                sets = list(shingle_sets(some, width))
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                digest = np.zeros((len(sets), 2), np.uint64)
                keys, sketch = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), SKETCH_BITS // 64), np.uint64)
                if len(full):
                    for i in full.tolist():
                        digest[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), np.uint64)
                    samples = _min_hashes([sets[i] for i in full.tolist()])
                    keys[full], sketch[full] = _band_keys(samples), odd_sketches(samples)
                yield pa.record_batch([
                    b.column(0).slice(first, len(some)), pa.array(size), pa.array(signed(digest[:, 0].copy())), pa.array(signed(digest[:, 1].copy())),
                    _lists(keys), _lists(sketch)], names=["doc_id", "n_shingles", "hi", "lo", "bands", "sketch"])

    return run


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(signed(rows.ravel())))


def _sets_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in slices(texts(b.column(1))):
                sets = list(shingle_sets(some, width))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                print_ = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
                yield pa.record_batch([b.column(0).slice(first, len(some)), pa.array(signed(np.array(print_, np.uint64))), pa.array(np.diff(ends)),
                                       pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(sets))))], names=["id", "print", "n", "grams"])

    return run


def _allowed(left: dict, right: dict, most: int, percent: int) -> np.ndarray:
    """Which pairs of the two sides could be linked: other class, sketches and sizes near enough."""
    bits = np.bitwise_count(left["sketch"][:, None, :] ^ right["sketch"][None, :, :]).sum(2, dtype=np.int32)
    small, large = np.minimum(left["n"][:, None], right["n"]), np.maximum(left["n"][:, None], right["n"])
    fit = (bits <= most) & (left["class"][:, None] != right["class"]) & (100 * small >= percent * large)
    return np.where(fit, bits, SKETCH_BITS + 1)


def _joined(left: dict, right: dict, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Every node that could be linked, with the smallest node it is connected to over such pairs."""
    fit = _allowed(left, right, most, percent) <= SKETCH_BITS
    far = np.iinfo(np.int64).max
    a, b = left["id"].copy(), right["id"].copy()
    while True:
        new_a = np.minimum(a, np.where(fit, b, far).min(1))
        new_b = np.minimum(b, np.where(fit, new_a[:, None], far).min(0))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    ids, roots = np.concatenate([left["id"], right["id"]]), np.concatenate([a, b])
    moved = ids != roots
    return roots[moved], ids[moved]


def _linked(left: dict, right: dict, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links confirmed on the full sets, as many as it takes to join what is linked; the most similar pairs are tried first."""
    bits = _allowed(left, right, most, percent)
    rows, cols = np.nonzero(bits <= SKETCH_BITS)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for k in np.argsort(bits[rows, cols], kind="stable").tolist():
        x, y = rows[k], cols[k]
        p, q = find(int(left["class"][x])), find(int(right["class"][y]))
        if p != q:
            g, h = left["grams"][x], right["grams"][y]
            common = len(np.intersect1d(g, h, assume_unique=True))
            if 100 * common >= percent * (len(g) + len(h) - common):
                parent[max(p, q)] = min(p, q)
                out.append((left["id"][x], right["id"][y]))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs.min(1), pairs.max(1)


def _meet(compare, most: int, percent: int, grams: bool):
    """Kernel over rows (key, i, j, id, class, n, block, sketch[, grams]) sorted by key, i, j: ``compare`` for blocks i and j of each."""

    def side(t: pa.Table, at: np.ndarray) -> dict:
        some = t.take(pa.array(at))
        flat = lambda name: some.column(name).combine_chunks().flatten().to_numpy()
        out = {c: some.column(c).to_numpy() for c in ("id", "class", "n")}
        out["sketch"] = flat("sketch").view(np.uint64).reshape(len(at), -1)
        if grams:
            out["grams"] = np.split(flat("grams"), np.cumsum(out["n"])[:-1])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(last: bool) -> Iterator[tuple]:
            nonlocal held
            t = pa.Table.from_batches(held)
            keys = np.column_stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()] + ([len(t)] if last else [])
            classes, blocks = t.column("class").to_numpy(), t.column("block").to_numpy()
            for s, e in zip(cuts[:-1], cuts[1:]):
                if (classes[s:e] != classes[s]).any():
                    left, right = s + np.flatnonzero(blocks[s:e] == keys[s, 1]), s + np.flatnonzero(blocks[s:e] == keys[s, 2])
                    if len(left) and len(right):
                        yield side(t, left), side(t, right)
            held = [] if last else t.slice(cuts[-1]).combine_chunks().to_batches()

        def out(meetings) -> Iterator[pa.RecordBatch]:
            found = [compare(left, right, most, percent) for left, right in meetings]
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                first, end = held[0], b.num_rows - 1
                if any(first.column(c)[0] != b.column(c)[end] for c in (0, 1, 2)):
                    yield from out(groups(False))
        if held:
            yield from out(groups(True))

    return run


def _meetings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (key, id, class, main, ...) repeated for the blocks they have to meet: others with others and with the main class."""
    own = F.col("class") == F.col("main")
    sizes = rows.groupBy("key").agg(F.ceil(F.count_if(~own) / BLOCK).alias("others"), F.ceil(F.count_if(own) / BLOCK).alias("mains"))
    rows = rows.join(stored(sizes.filter(F.col("others") > 0)), "key")
    mine = F.pmod(F.xxhash64("id"), F.when(own, F.col("mains")).otherwise(F.col("others")))
    rows = rows.withColumn("block", F.when(own, F.col("others") + mine).otherwise(mine))
    partners = F.when(own, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), partners - 1)))
    rows = rows.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "id", "class", "n", "block", *columns)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


class NearDuplicates:
    """Classes of texts whose shingle sets reach ``percent`` / 100 similarity, directly or over others."""

    def __init__(self, docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text"):
        self.width, self.percent, self.most = width, percent, most_bits(percent / 100)
        self.docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
        self.signed = stored(self.docs.mapInArrow(_sign(width), _SHAPE))
        usable = self.signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        one = usable.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("s"))
        self.nodes = stored(one.select("hi", "lo", F.col("s.doc_id").alias("id"), F.col("s.n_shingles").alias("n"), "s.bands", "s.sketch"))
        keyed = self.nodes.select("id", F.explode("bands").alias("key"))
        shared = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
        self.shared = stored(keyed.join(shared, "key"))

    def _sets(self) -> DataFrame:
        """(id, n, grams) of every node that shares a bucket."""
        wanted = stored(self.shared.select(F.col("id").alias("doc_id")).distinct())
        sets = self.docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets_of(self.width), "id long, print long, n int, grams array<long>")
        return stored(sets.groupBy("id", "print").agg(F.first("n").alias("n"), F.first("grams").alias("grams")).drop("print"))

    def _confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the similarity."""
        both = pairs.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
        both = both.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
        common = F.size(F.array_intersect("grams_a", "grams_b"))
        return both.filter(100 * common >= self.percent * (F.size("grams_a") + F.size("grams_b") - common)).select("a", "b").distinct()

    def _bits(self, x: str, y: str) -> Column:
        words = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        return F.aggregate(words, F.lit(0), lambda t, v: t + v)

    def star_pairs(self) -> DataFrame:
        """Every node with the smallest node of its buckets, as far as sketch and size allow a link."""
        pairs = self.shared.filter(F.col("id") != F.col("leader")).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        of = self.nodes.select("id", "n", "sketch").groupBy("id").agg(F.max(F.struct("n", "sketch")).alias("s"))
        a = of.select(F.col("id").alias("a"), F.col("s.n").alias("n_a"), F.col("s.sketch").alias("sketch_a"))
        b = of.select(F.col("id").alias("b"), F.col("s.n").alias("n_b"), F.col("s.sketch").alias("sketch_b"))
        near = pairs.join(b, "b").join(a, "a")
        near = near.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")).filter(self._bits("sketch_a", "sketch_b") <= self.most)
        return near.select("a", "b")

    def classes(self) -> DataFrame:
        """(id, component) of all nodes that belong to a class, but for the smallest of each."""
        sets = self._sets()
        links = stored(self._confirmed(self.star_pairs(), sets))
        found = components(links)
        named = self.nodes.select("id", "n", "sketch").join(found, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
        named = stored(named.join(self.shared.select("id").distinct(), "id", "left_semi"))
        # Nodes that could be linked, bucket by bucket; the main class of a bucket is that of its smallest node.
        main = named.select(F.col("id").alias("leader"), F.col("class").alias("main"))
        rows = self.shared.select("key", "leader", "id").join(main, "leader").join(named, "id")
        joined = _meetings(rows.drop("leader"), ["sketch"]).mapInArrow(_meet(_joined, self.most, self.percent, False), "a long, b long")
        families = components(joined)
        heads = families.select(F.col("component").alias("id"), F.col("component").alias("key")).distinct()
        members = stored(families.select("id", F.col("component").alias("key")).unionByName(heads).join(named, "id"))
        counted = members.groupBy("key", "class").count()
        main = stored(counted.groupBy("key").agg(F.max_by("class", F.struct("count", "class")).alias("main")))
        rows = members.drop("n").join(main, "key").join(sets, "id")
        more = _meetings(rows, ["sketch", "grams"]).mapInArrow(_meet(_linked, self.most, self.percent, True), "a long, b long")
        return components(links.unionByName(stored(more)))

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept of every row."""
        classed = self.nodes.select("hi", "lo", "id").join(self.classes(), "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("_class"))
        usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
        out = self.signed.select("doc_id", "n_shingles", F.when(usable, F.col("hi")).alias("hi"), F.when(usable, F.col("lo")).alias("lo"))
        out = out.join(classed, ["hi", "lo"], "left").withColumn("component_id", F.coalesce("_class", "doc_id"))
        return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id of its class), kept."""
    return NearDuplicates(docs, width, percent, id_col, text_col).result()
