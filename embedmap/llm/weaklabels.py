"""Weak labels for unwanted documents and a hashed linear scorer trained on them.

Heuristic labellers vote on every whole text: 1 (unwanted), 0 (fine) or 2 (no opinion). For each target, documents are counted by
pattern of votes, with the known label where one exists; the patterns are at most 3^labellers, however many
documents there are. Expectation-maximisation over these counts estimates how each labeller votes in either class (known labels stay
fixed), and so a posterior per pattern. The posteriors are the labels of a logistic scorer over hashed words and votes, fitted on a sample
of about ``SAMPLE`` documents per posterior class (all of a smaller class) and applied to all of them.

The toxic lexicon is a labeller too: words that at least ``LEXICON_DOCS`` toxic documents of about ``LABELLED`` labelled ones
hold and few others do.

Defined cases: null and blank texts vote as short texts; ids that are null have no known label; of several labels of one id the largest
counts; repeated rows are scored one by one; without documents there are no rows, without labels the labellers start from their own
votes; other columns pass through, and ``_weak`` is the only new name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedmap.llm.hostrules import count_columns
from embedmap.llm.tables import carried, released, stored
from embedmap.llm.words import slices, split_words, texts

#: Documents per posterior class on which the scorer is fitted, and labelled documents from which the lexicon is drawn.
SAMPLE = 6000
LABELLED = 20_000
#: A lexicon word is held by so many toxic documents, and by this share of them.
LEXICON_DOCS = 5
LEXICON_OF_TOXIC = 0.01
#: Weight of all unlabelled documents together against the labelled ones.
UNLABELLED = 0.2
LEXICON_SHARE = 0.8
LEXICON_WORDS = 20_000
FEATURES = 1 << 18
EPOCHS = 6

#: Words of abuse that the seed labeller knows (fixed values).
SEEDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

TARGETS = {
    "junk": ("symbols", "shouting", "word_length", "short", "dup_lines", "repeats"),
    "toxic": ("lexicon", "lexicon_rate", "seeds"),
}
LABELLERS = tuple(name for names in TARGETS.values() for name in names)
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _bare(word: str) -> str:
    return word.strip(_EDGE).lower()


def _vote(bad: np.ndarray, fine: np.ndarray) -> np.ndarray:
    return np.where(bad, 1, np.where(fine, 0, 2)).astype(np.int64)


class Reader:
    """Votes and distinct words of the texts of a column."""

    def __init__(self, column: pa.Array, lexicon: set[str]):
        n_words, chars, symbols, dup, repeat, lines, upper = count_columns(column)
        distinct, codes, bounds = split_words(column)
        self.words = [_bare(w) for w in distinct.to_numpy(zero_copy_only=False).tolist()]
        n = len(column)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        size = max(1, len(self.words))
        pairs = np.unique(doc * size + codes)
        self.doc, self.code = pairs // size, pairs % size
        seeds = frozenset(SEEDS)
        known = np.fromiter((w in lexicon for w in self.words), bool, len(self.words))
        seed = np.fromiter((w in seeds for w in self.words), bool, len(self.words))
        hits = np.bincount(doc, known[codes] if len(codes) else None, n) if len(codes) else np.zeros(n)
        seeded = np.bincount(doc, seed[codes], n) if len(codes) else np.zeros(n)
        self.votes = np.stack([
            _vote(4 * symbols > n_words, 20 * symbols < n_words), _vote(2 * upper > chars, 5 * upper < chars),
            _vote(chars > 12 * n_words, (chars < 9 * n_words) & (chars > 2 * n_words)), _vote(n_words < 5, n_words >= 20),
            _vote((lines >= 4) & (100 * dup > 30 * lines), dup == 0), _vote(100 * repeat > 30 * n_words, repeat == 0),
            _vote(hits >= 2, hits == 0), _vote((hits > 0) & (200 * hits >= n_words), 2000 * hits < n_words), _vote(seeded >= 2, np.zeros(n, bool)),
        ]) if n else np.zeros((len(LABELLERS), 0), np.int64)

    def patterns(self) -> dict[str, np.ndarray]:
        """Votes of each target's labellers as one base-3 number."""
        out = {}
        for target, names in TARGETS.items():
            number = np.zeros(self.votes.shape[1], np.int64)
            for name in names:
                number = 3 * number + self.votes[LABELLERS.index(name)]
            out[target] = number
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and hashed feature of every distinct word and every vote."""
        of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) % FEATURES for w in self.words), np.int64, len(self.words))
        n = self.votes.shape[1]
        of_vote = np.array([[xxhash.xxh3_64_intdigest(f"vote {name} {v}") % FEATURES for v in range(3)] for name in LABELLERS], np.int64)
        votes = of_vote[np.arange(len(LABELLERS))[:, None], self.votes]
        doc = np.concatenate([self.doc, np.tile(np.arange(n), len(LABELLERS))])
        feature = np.concatenate([of_word[self.code] if len(self.code) else np.zeros(0, np.int64), votes.ravel()])
        order = np.argsort(doc, kind="stable")
        return doc[order], feature[order]


def _on_texts(at: int, name: str, lexicon, make):
    """mapInArrow kernel that appends ``make(reader)``, one Arrow array per slice of texts, as column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = set(lexicon.value)
        for b in batches:
            for first, some in slices(texts(b.column(at))):
                yield pa.RecordBatch.from_arrays([*[c.slice(first, len(some)) for c in b.columns], make(Reader(some, words))], names=[*b.schema.names, name])

    return run


def _structs(reader: Reader) -> pa.Array:
    p = reader.patterns()
    return pa.StructArray.from_arrays([pa.array(p[t]) for t in TARGETS], list(TARGETS))


def _feature_lists(reader: Reader) -> pa.Array:
    doc, feature = reader.features()
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=reader.votes.shape[1]))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(feature))


def _with(docs: DataFrame, text_col: str, name: str, kind: T.DataType, lexicon, make) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    return docs.mapInArrow(_on_texts(docs.columns.index(text_col), name, lexicon, make), schema)


_PATTERNS = T.StructType([T.StructField(t, T.LongType()) for t in TARGETS])


def _drawn(id_col: str) -> Column:
    """Uniform number of 0..1 that depends on the id only: a share of the rows without sorting or gathering them."""
    return F.pmod(F.xxhash64(F.lit("drawn"), id_col), F.lit(1 << 31)) / F.lit(float(1 << 31))


def toxic_lexicon(docs: DataFrame, labels: DataFrame) -> list[str]:
    """Words held by many toxic and few other documents, of at most LABELLED labelled documents."""
    some = labels.filter(F.col("toxic").isNotNull())
    some = some.filter(_drawn("id") < LABELLED / max(1, some.count()))
    held = docs.join(F.broadcast(some.select("id", "toxic")), "id").select(
        "toxic", F.explode(F.array_distinct(F.transform(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: F.lower(F.btrim(w, F.lit(_EDGE)))))).alias("word"))
    least = max(LEXICON_DOCS, LEXICON_OF_TOXIC * (some.agg(F.sum("toxic")).first()[0] or 0))
    by_word = held.filter(F.char_length("word") >= 3).groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    chosen = by_word.filter((F.col("bad") >= least) & (F.col("bad") >= LEXICON_SHARE * F.col("n")))
    return sorted(r.word for r in chosen.orderBy(F.desc("bad"), "word").limit(LEXICON_WORDS).collect())


def fit_votes(patterns: np.ndarray, gold: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over pattern counts: P(vote | class) as (2, labellers, 3), posteriors of the patterns, share of class 1.

    ``gold`` is the known class of a row of counts, or -1.
    """
    votes = np.stack([(patterns // 3 ** (labellers - 1 - j)) % 3 for j in range(labellers)], 1)
    onehot = votes[:, :, None] == np.arange(3)
    # Start: the share of opinions that say unwanted, slightly below one half without any opinion.
    said, against = (votes == 1).sum(1), (votes == 0).sum(1)
    q = (0.4 + 2 * said) / (1 + 2 * said + against)
    q = np.where(gold >= 0, gold, q).astype(float)
    # Many unlabelled rows would turn the classes into whatever else divides the corpus; together they weigh a fifth of the known ones.
    known, free = counts[gold >= 0].sum(), counts[gold < 0].sum()
    if known and free:
        counts = np.where(gold >= 0, counts, counts * min(1.0, UNLABELLED * known / free))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        rates = (np.einsum("cn,njv->cjv", weight, onehot) + 1.0) / (weight.sum(1)[:, None, None] + 3.0)
        share = (weight[1].sum() + 1.0) / (counts.sum() + 2.0)
        score = np.einsum("njv,cjv->nc", onehot, np.log(rates)) + np.log([1 - share, share])
        free = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
        after = np.where(gold >= 0, gold, free)
        done = np.abs(after - q).max(initial=0) < 1e-9
        q = after
        if done:
            break
    return rates, free, share


def _fit_scorer(epochs: int):
    """Logistic regression with soft labels over the rows of the (bounded) sample, one weight column per target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables).combine_chunks().sort_by([("order", "ascending")])
        lists = t.column("features").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        wanted = np.stack([t.column(n).to_numpy() for n in TARGETS], 1)
        weights, energy = np.zeros((FEATURES, len(TARGETS))), np.full((FEATURES, len(TARGETS)), 1e-6)
        bias = np.zeros(len(TARGETS))
        for epoch in range(epochs):
            for at in range(0, len(sizes), 128):
                rows = slice(at, min(at + 128, len(sizes)))
                span = flat[starts[rows.start]:starts[rows.stop - 1] + sizes[rows.stop - 1]]
                row = np.repeat(np.arange(rows.stop - rows.start), sizes[rows])
                scale = 1 / np.sqrt(np.maximum(sizes[rows], 1))
                for j in range(len(TARGETS)):
                    z = bias[j] + np.bincount(row, weights[span, j], len(scale)) * scale
                    wrong = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - wanted[rows, j]
                    touched, place = np.unique(span, return_inverse=True)
                    slope = np.bincount(place, (wrong * scale)[row], len(touched)) + 1e-4 * weights[touched, j]
                    energy[touched, j] += slope * slope
                    weights[touched, j] -= 0.5 * slope / np.sqrt(energy[touched, j])
                    bias[j] -= 0.02 * wrong.mean()
        used = np.flatnonzero((np.abs(weights) > 1e-6).any(1))
        yield pa.record_batch([pa.array(np.append(used, -1)), pa.array(np.vstack([weights[used], bias]).tolist(), pa.list_(pa.float64()))], names=["feature", "weights"])

    return run


def _score(weights):
    def make(reader: Reader) -> pa.Array:
        w = np.frombuffer(weights.value).reshape(FEATURES + 1, len(TARGETS))
        doc, feature = reader.features()
        n = reader.votes.shape[1]
        scale = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
        p = reader.patterns()
        cols = [pa.array(p[t]) for t in TARGETS]
        for j in range(len(TARGETS)):
            z = w[FEATURES, j] + np.bincount(doc, w[feature, j], n) * scale
            cols.append(pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
        return pa.StructArray.from_arrays(cols, [*TARGETS, *[f"{t}_score" for t in TARGETS]])

    return make


def _posterior(number: Column, table: dict[int, float]) -> Column:
    """Posterior of a pattern (a bounded table of at most 3^labellers entries)."""
    pairs = [F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), number), F.lit(0.0)) if pairs else F.lit(0.0)


def weak_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
                known: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with the struct ``_weak``: posterior and score of each target, and kept (neither target is likely)."""
    spark = docs.sparkSession
    known = known or {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
    gold = labels.select(labels[label_id].alias("id"), *[known[t].cast("int").alias(t) for t in TARGETS])
    gold = gold.filter(F.col("id").isNotNull()).groupBy("id").agg(*[F.max(t).alias(t) for t in TARGETS])
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    lexicon = spark.sparkContext.broadcast(toxic_lexicon(slim, gold))
    voted = stored(_with(slim, "text", "p", _PATTERNS, lexicon, _structs).drop("text"))
    joined = voted.join(gold, "id", "left")
    tables: dict[str, dict[int, float]] = {}
    for target, names in TARGETS.items():
        counted = joined.groupBy(F.col(f"p.{target}").alias("p"), F.coalesce(target, F.lit(-1)).alias("gold")).count().orderBy("p", "gold").collect()
        p, g, n = (np.array([r[i] for r in counted], np.int64) for i in range(3))
        _, posterior, _ = fit_votes(p, g, n.astype(float), len(names))
        tables[target] = dict(zip(p.tolist(), posterior.tolist()))
    wanted = joined.select("id", *[F.coalesce(F.col(t).cast("double"), _posterior(F.col(f"p.{t}"), tables[t])).alias(t) for t in TARGETS])
    order = F.md5(F.col("id").cast("string").cast("binary"))
    likely = F.concat_ws(",", *[(F.col(t) > 0.5).cast("string") for t in TARGETS])
    wanted = wanted.filter(F.col("id").isNotNull()).withColumn("_class", likely)
    shares = [x for r in wanted.groupBy("_class").count().collect() for x in (F.lit(r[0]), F.lit(min(1.0, SAMPLE / r[1])))]  # 2^targets classes
    sample = wanted.filter(_drawn("id") < F.element_at(F.create_map(*shares), F.col("_class"))) if shares else wanted
    sample = stored(sample.groupBy("id").agg(*[F.max(t).alias(t) for t in TARGETS]))
    rows = slim.join(F.broadcast(sample), "id")  # about SAMPLE documents per class
    lists = _with(rows, "text", "features", T.ArrayType(T.LongType()), lexicon, _feature_lists)
    # Of several texts of one id, the one with the least features is drawn, whatever the layout.
    lists = stored(lists.groupBy(order.alias("order")).agg(F.min(F.struct("features", *TARGETS)).alias("f")).select("order", "f.*"))
    fitted = lists.coalesce(1).mapInArrow(_fit_scorer(EPOCHS), "feature long, weights array<double>").collect()
    weights = np.zeros((FEATURES + 1, len(TARGETS)))
    for r in fitted:
        weights[r.feature] = r.weights
    weights = spark.sparkContext.broadcast(weights.tobytes())
    kind = T.StructType([*_PATTERNS.fields, *[T.StructField(f"{t}_score", T.DoubleType()) for t in TARGETS]])
    # The text is named beside the carried row, so that no column of the input meets a helper.
    out = _with(carried(docs, "_weak", text=docs[text_col]), "text", "p", kind, lexicon, _score(weights))
    fields, bad = [], F.lit(False)
    for t in TARGETS:
        posterior, score = _posterior(F.col(f"p.{t}"), tables[t]), F.col(f"p.{t}_score")
        fields += [F.round(posterior, 9).alias(f"{t}_posterior"), F.round(score, 9).alias(f"{t}_score")]
        bad = bad | ((posterior + score) / 2 > 0.5)
    return released(out, docs.columns, "_weak", F.struct(*fields, (~bad).alias("kept")))
