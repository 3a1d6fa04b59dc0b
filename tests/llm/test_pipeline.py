"""The pipeline: its stages one by one, and the whole."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from scantling.llm import mixing
from scantling.llm.util import materialize
from tests.llm.test_llm import ODD


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "mixing", "encoding"]


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialize(stage(spark, docs, sf), f"test-{name}")
        if k < 4:
            assert after.columns == docs.columns
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.3 * len(ids)
        if name == "mixing":
            assert after.count() == sum(r["copies"] for r in mixing.mix(docs).collect())
        docs, ids = after, kept
    assert corpus_pipeline.run(spark, sf).count() == docs.count() and docs.where("NOT round_trip").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_empty_documents(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[k][1](spark, docs, sf).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_odd_documents(spark, sf, k):
    """Nulls in every column, repeated rows and ids, a very long text, and columns named like those that stages make."""
    docs = spark.createDataFrame([(*row, None) for row in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("id", "copies", "size", "rank", "fp", "kept", "quality", "component_id")})
    name, stage = corpus_pipeline.STAGES[k]
    got = materialize(stage(spark, docs, sf), f"odd-{name}")
    if k < 4:
        assert got.columns == docs.columns
    if name == "near_dedup":
        assert got.count() == len(ODD) - 3  # two empty texts of one group, and the copy of document 5
    if name == "encoding":
        assert got.count() == len(ODD)
