"""Quality rules per document, judged with the record of its host.

Counts of every whole text feed a base rule and softer rules. Failures of each soft rule are summed by host, and the rate of
a host is shrunk towards the corpus: a beta prior is fitted to the rates of all hosts by their mean and variance, and the
posterior mean takes the place of the raw rate, so that hosts with few documents say little. Where the shrunk rate of a
rule is above ``tolerance``, failing it is the habit of that host and its failing documents go; below it is taken for an accident
and they stay. A document that fails nothing is never dropped for its host.

The counts are taken in the tasks that read the texts, once for the hosts and once for the verdicts, so no text is shuffled.

Defined cases: null texts have no words (and fail the base rule); a null host is the empty one; repeated rows count and are
judged one by one; an empty table gives no rows; other columns pass through, whatever their names, and ``_quality`` is the only new
name (a column of that name gives way to it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedmap.llm.tables import carried, released, small, stored
from embedmap.llm.words import mix, rolling, slices, split_words, texts

REPEAT_WINDOW = 8
MIN_WORDS = 20
#: Largest share, in percent, of words in repeated windows.
REPEAT_PERCENT = 30
#: Shrunk failure rate above which a rule counts against a host's failing documents.
TOLERANCE = 0.01

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True


def _bytes_in(column: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Number of bytes of each text that are in ``wanted``."""
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    total = np.concatenate([[0], np.cumsum(wanted[data])])
    return np.diff(total[ends - ends[0]])


def _repeat_words(codes: np.ndarray, bounds: np.ndarray, distinct: int, width: int) -> np.ndarray:
    """Words of each text in windows of ``width`` words that the text has twice or more."""
    n = len(bounds) - 1
    if len(codes) < width:
        return np.zeros(n, np.int64)
    number = mix(np.arange(1, distinct + 1, dtype=np.uint64))
    doc = np.repeat(np.arange(n), np.diff(bounds))
    inside = doc[:len(doc) - width + 1] == doc[width - 1:]
    keys = mix(mix(rolling(number[codes], width)) + doc[:len(inside)].astype(np.uint64))
    at = np.flatnonzero(inside)
    order = np.argsort(keys[at], kind="stable")
    k = keys[at][order]
    same = k[1:] == k[:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = at[order[twice]]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return np.diff(covered[bounds])


def _line_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text that have a word, and those of them equal to an earlier one."""
    lists = pc.split_pattern(column, "\n")
    coded = lists.flatten().dictionary_encode()
    blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(column)), np.diff(ends))
    codes = coded.indices.to_numpy().astype(np.int64)
    real = ~blank[codes]
    doc, codes = doc[real], codes[real]
    each = np.unique(doc * max(1, len(blank)) + codes) // max(1, len(blank))
    lines = np.bincount(doc, minlength=len(column))
    return lines, lines - np.bincount(each, minlength=len(column))


def count_columns(column: pa.Array) -> list[np.ndarray]:
    """The COUNTS of each text."""
    distinct, codes, bounds = split_words(column)
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(chars[codes] if len(codes) else np.zeros(0, np.int64))])
    lines, dup = _line_counts(column)
    return [np.diff(bounds), np.diff(total[bounds]), _bytes_in(column, _SYMBOL), dup,
            _repeat_words(codes, bounds, len(distinct), REPEAT_WINDOW), lines, _bytes_in(column, _UPPER)]


def _measure(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [count_columns(some) for _, some in slices(texts(pc.struct_field(b.column(0), [at])))]
            counts = [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(counts, COUNTS)], names=["row", "counts"])

    return run


def measured(docs: DataFrame, text_col: str = "text", into: str = "_quality") -> DataFrame:
    """(row, counts): every row of ``docs`` as a struct, and its COUNTS."""
    rows = carried(docs, into)
    counts = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return rows.mapInArrow(_measure(docs.columns.index(text_col)), T.StructType([*rows.schema.fields, T.StructField("counts", counts)]))


def base_failed() -> Column:
    c = F.col("counts")
    return (c.n_words < MIN_WORDS) | (100 * c.n_repeat_words > REPEAT_PERCENT * c.n_words)


def soft_rules() -> dict[str, Column]:
    """Failures that count only where they are a host's habit."""
    c = F.col("counts")
    return {
        "symbols": 4 * c.n_symbols > c.n_words,
        "shouting": 2 * c.n_upper > c.word_chars,
        "dup_lines": (c.n_lines >= 4) & (100 * c.n_dup_lines > 30 * c.n_lines),
        "long_words": c.word_chars > 12 * c.n_words,
    }


def host_rates(counted: DataFrame, host: Column) -> DataFrame:
    """One row per host: documents and, per soft rule, failures and the rate shrunk by the empirical beta prior."""
    rules = soft_rules()
    hosts = stored(counted.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(f"f_{name}") for name, r in rules.items()]))
    moments = []
    for name in rules:
        f, rate = F.col(f"f_{name}"), F.col(f"f_{name}") / F.col("n")
        moments += [(F.sum(f) / F.sum("n")).alias(f"m_{name}"), (F.sum("n") / F.count(F.lit(1))).alias(f"size_{name}"),
                    (F.sum(F.col("n") * rate * rate) / F.sum("n") - F.pow(F.sum(f) / F.sum("n"), F.lit(2))).alias(f"v_{name}")]
    seen = hosts.agg(*moments).first()
    out = hosts
    for name in rules:
        m, v, size = (seen[f"{x}_{name}"] or 0.0 for x in ("m", "v", "size"))
        # Spread between hosts beyond what draws of the mean size give by chance.
        own = max(v - m * (1 - m) / max(size, 1.0), 1e-9)
        strength = min(max(m * (1 - m) / own - 1, 1.0), 1000.0)
        out = out.withColumn(f"rate_{name}", (F.col(f"f_{name}") + m * strength) / (F.col("n") + strength))
    return out


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", tolerance: float = TOLERANCE, into: str = "_quality") -> DataFrame:
    """``docs`` with the struct ``into``: the counts, base_failed, the soft rules that decided against it, and kept."""
    host = lambda name: F.coalesce(F.col("row").getField(name).cast("string"), F.lit(""))
    need = docs.select(docs[host_col].alias("source"), docs[text_col].alias("text"))
    rates = host_rates(measured(need), host("source"))
    rules = soft_rules()
    verdicts = rates.select("host", F.array_compact(F.array(*[F.when(F.col(f"rate_{name}") > tolerance, F.lit(name)) for name in rules])).alias("strict"))
    joined = measured(docs, text_col, into).withColumn("host", host(host_col)).join(small(verdicts), "host", "left")
    failed = F.array_compact(F.array(*[F.when(r, F.lit(name)) for name, r in rules.items()]))
    against = F.array_intersect(failed, F.col("strict"))
    joined = joined.withColumn("base", F.coalesce(base_failed(), F.lit(True))).withColumn("against", F.coalesce(against, F.array().cast("array<string>")))
    fields = [F.col(f"counts.{c}").alias(c) for c in COUNTS]
    quality = F.struct(*fields, F.col("base").alias("base_failed"), F.col("against").alias("host_rules"),
                       (~F.col("base") & (F.size("against") == 0)).alias("kept"))
    return released(joined, docs.columns, into, quality)
