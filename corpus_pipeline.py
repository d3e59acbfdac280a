"""The corpus pipeline: documents in, packed sequences out.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written and read again before the next one. SQL cannot express the first
stage, a trained classifier, so tests hold the pipeline against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridseries.llm.common import read, stage
from gridseries.llm.exact_dedup import drop_exact_copies
from gridseries.llm.language import drop_unidentified
from gridseries.llm.mixing import mixed_documents
from gridseries.llm.near_dedup import drop_near_copies
from gridseries.llm.packing import pack
from gridseries.llm.queries import tokenizer_path


#: Rows of the Arrow batches that tasks exchange with Python: documents can be long, so fewer than Spark's default.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to at most BATCH_ROWS rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without a letter go, null and empty ones among them.

    Like all stages: rows repeated with their id are rows of their own, and an
    empty table gives an empty one.
    """
    bounded_batches(spark)
    return drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, equal but for the case of A-Z: that of the largest id, null ids last; null is an empty text."""
    bounded_batches(spark)
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; texts without words stay, as do groups of null ids."""
    bounded_batches(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them, rounded to whole copies; a null source is a source."""
    bounded_batches(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; a null or empty text is its end token."""
    bounded_batches(spark)
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
