"""The corpus pipeline: from documents to packed training sequences, in five stages.

Each stage takes all rows that its predecessor kept. Between stages the rows are written as Parquet
to the shared folder and read again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import line_templates, packing, parity_join, passage_dedup, toxicity_fm
from blockloom.llm.shared import Scratch, shrink_executors, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go. It learns from the labelled rows outside the held-out fold."""
    model = toxicity_fm.train(docs, table(spark, sf_dir, "labels"))
    return toxicity_fm.keep_clean(docs.select(*COLUMNS), model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all but the least document that has them."""
    return _documents(line_templates.drop_recurring_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the least stays."""
    return parity_join.keep_one_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a lesser document keeps are cut out."""
    return _documents(passage_dedup.cut_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers as vocab

    return packing.pack(docs, vocab.path("byte_bpe_50k.json"), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)


def _after_others(stage: Stage) -> Stage:
    """The stage, begun with executors that hold no heap of the one before."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_executors(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [
    ("toxicity", _after_others(toxicity)),
    ("line_dedup", _after_others(line_dedup)),
    ("near_duplicates", _after_others(near_duplicates)),
    ("substring_dedup", _after_others(substring_dedup)),
    ("packing", _after_others(pack)),
]

#: A fitted model, connected components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage gives for documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
