"""The training-corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Quality classifier, language ID, SimHash near-dedup, mixing of sources to target weights, BPE encoding and decoding. Every stage
takes all that the one before it kept. All but the last return the columns of documents; the last returns for each document of
the mix its key columns, ids and digests. Tables without rows pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scantling.llm.bpe import encode_documents
from scantling.llm.langid import keep_identified
from scantling.llm.mixing import take
from scantling.llm.quality_model import keep_good
from scantling.llm.simhash import keep_one
from scantling.llm.util import drop_materialized, materialize, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language has at least half."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every document of the mix."""
    return encode_documents(docs, ["doc_id", "lang", "source"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("language", language), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding),
]
#: The classifier, the mixture inference and the fingerprints have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        docs = _written(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_materialized(before)
        before = docs
    return docs


def _written(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What a stage makes, written; what it wrote on the way is deleted."""
    with scratch(spark) as made:
        return made.keep(materialize(make(), label))
