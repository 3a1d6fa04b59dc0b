"""The queries of this subpackage, each an operator applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.llm.bpe import encode_documents
from scantling.llm.flac import digest_media, encode_media
from scantling.llm.html_extract import extract
from scantling.llm.langid import identify
from scantling.llm.licenses import oracle as license_sql
from scantling.llm.licenses import scan
from scantling.llm.mixing import ORACLE_SQL as MIXING_SQL
from scantling.llm.mixing import mix
from scantling.llm.quality_model import classify
from scantling.llm.quality_rules import apply_rules
from scantling.llm.simhash import near_duplicates
from scantling.llm.token_files import count_tokens
from scantling.llm.util import table


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as FLAC, read back and digested."""
    return digest_media(encode_media(table(spark, sf_dir, "documents"), linear_order=4), ["doc_id", "n_bytes"])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document and whether it is kept."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "copies", "taken")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document holds."""
    return scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and compression bands over every document."""
    return apply_rules(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_flac": op1_flac,
        "op2_bpe": op2_bpe,
        "op3_quality_model": op3_quality_model,
        "op4_html": op4_html,
        "op5_token_counts": op5_token_counts,
        "op6_simhash": op6_simhash,
        "op7_mixing": op7_mixing,
        "op8_langid": op8_langid,
        "op9_licenses": op9_licenses,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": MIXING_SQL, "op9_licenses": license_sql()}
