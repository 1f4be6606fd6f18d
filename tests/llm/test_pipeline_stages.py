"""Each stage of the pipeline by itself: nulls in any column, empty and long texts, repeated rows, clashing columns, an empty table."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chartloom.llm import packing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, score double, matches array<string>, base string, terms string, shard int"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    extra = ("x", 0.5, None, "b", "t", 1)
    out = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], *extra) for r in given]
    long_text = " ".join(r["text"] for r in given) * 3
    odd = [None, "", " ", "7 8 9", "…", long_text, f"{given[0]['text']} {item}", "write to jane.doe@mail.example.org or 10.0.0.7"]
    out += [(1000 + i, t, None if i % 2 else "en", None, None, *extra) for i, t in enumerate(odd)]
    out += [(None, "a text without an id but with a few words of its own", None, None, None, *(None,) * 6), out[3], out[3], out[60]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage(spark, docs, rows, name):
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    got = [tuple(r) for r in out.collect()]
    key = lambda r: (r[0], r[2:4], r[5:])
    many, kept = collections.Counter(map(repr, map(key, rows))), collections.Counter(map(repr, map(key, got)))
    assert not kept - many
    by_id = {r[0]: r for r in got}
    if name == "language_id":
        assert not {1000, 1001, 1002, 1003, 1004} & set(by_id) and kept[repr(key(rows[3]))] in (0, 3) and len(got) > 40
    if name == "near_duplicate_join":
        assert {None, 1000, 1001, 1002} <= set(by_id) and kept[repr(key(rows[3]))] <= 1
    if name == "benchmark_decontamination":
        assert 1006 not in by_id and {None, 1000, 1001} <= set(by_id)
    if name == "personal_data":
        assert kept == many and by_id[1000][1] is None and by_id[1007][1].endswith("<EMAIL> or <IP>") and by_id[1007][4] == len(by_id[1007][1])
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0


def test_last_stage(spark, docs, rows):
    out = STAGES["best_fit_packing"](spark, docs, SF)
    pieces = out.select("doc_id", "length", "sequence_id", "offset", F.octet_length("ids").alias("bytes")).collect()
    assert all(r["bytes"] == 4 * r["length"] for r in pieces)
    ids = collections.Counter(r["doc_id"] for r in pieces)
    assert set(ids) == {r[0] for r in rows}
    by = collections.defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert STAGES["best_fit_packing"](spark, docs.limit(0), SF).count() == 0
