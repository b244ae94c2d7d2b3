"""Corpus pipeline: quality rules, line dedup, near-duplicate dedup, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over the whole of what the stage before it kept; all but the last return
the columns of ``docs``. ``run`` writes every stage as Parquet to the shared folder and reads it back for the next.
An empty table passes as one; columns beyond those of ``docs`` pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmap.llm import hostrules, lines, mixing, neardup, packing
from embedmap.llm.queries import tokenizer_path
from embedmap.llm.registry import query, table
from embedmap.llm.tables import free_name, stored


def _columns(docs: DataFrame) -> list[str]:
    """Quoted names of the columns of ``docs``."""
    return [f"`{c.replace('`', '``')}`" for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and aren't rejected with their host's record.

    Null and empty texts fail the base rule and go; repeated rows are judged one by one; a null source is the empty one.
    """
    name = free_name(docs, "_quality")
    return hostrules.judge(docs, into=name).filter(F.col(name)["kept"]).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents repeat; n_chars follows the text.

    A text that loses no line stays as it is, null included; rows of one id keep the same lines; no row goes, whatever is left of its text.
    """
    name = free_name(docs, "_lines")
    out, left = lines.dedup_lines(docs, into=name), F.col(name)["text"]
    changed = F.col(name)["n_dropped"] > 0
    new = {"text": F.when(changed, left).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts with 0.8 similarity of five-word shingles, the one with the smallest id.

    Rows of one id go or stay together; rows without an id, words or text stay.
    """
    verdicts = neardup.near_duplicates(docs, width=5, percent=80)
    goes = stored(verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("_goes")).distinct())
    return docs.join(goes.hint("shuffle_hash"), docs["doc_id"].cast("long") == goes["_goes"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix of sources: every document at least once, those of scarce sources up to four times.

    A null source is the empty one; a null text counts as its end alone; repeated rows are drawn each.
    """
    return mixing.mix(docs, budget="cover", into=free_name(docs, "_mix")).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 4096 ids; a null text is an empty one, and repeated rows are packed each."""
    # The workers of the stages before still hold their memory, so this one works in smaller slices than packing alone.
    return packing.pack(docs, tokenizer_path(), slice_chars=1 << 20, cache_pieces=350_000)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: Packing needs a tokenizer, which SQL doesn't have; the tests hold the pipeline against a plain Python version.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
