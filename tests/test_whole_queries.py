"""Queries whose SQL is absent or long ask the whole text of every benchmark item."""

import pytest

from chartloom import catalog
from chartloom.catalog import retrieval

SF = "/root/testdata/sf0.001"
NAMES = ["bm25_stemmed", "dedup_jaccard", "mmr_select", "hybrid_search", "single_pass_query", "verified_query", "deep_think", "deep_think_vectors", "gate_contradiction", "gate_quote_faithfulness", "gate_answer_completeness", "all_gates"]


@pytest.mark.parametrize("name", NAMES)
def test_every_item_is_asked(spark, name):
    items = {r["item_id"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id").collect()}
    assert {r["query_id"] for r in catalog.QUERIES[name](spark, SF).select("query_id").collect()} == items


def test_texts_are_whole(spark):
    want = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {r["query_id"]: r["text"] for r in retrieval.queries(spark, SF).collect()} == want
