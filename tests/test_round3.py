"""Findings of round 3: each of these tests failed before its change."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chartloom.catalog import retrieval
from chartloom.llm import decontaminate
from chartloom.llm.words import slices
from chartloom.operators import fulltext, hybrid, vector_cells
from chartloom.plans import upkeep

SF = "/root/testdata/sf0.001"


def test_structure_points_read_patterns_as_the_sql_does(spark):
    around = ["", "é", "ß", "я", "病", "٣", "_", "a", "\u000b", " ", "ſ", "K", "\U00011f50", "\U00016ac0"]
    texts = [t for c in around for t in (f"5{c}mg", f"5 mg{c}", f"5 {c}g", f"{c}5/6{c}", f"120 mmHg{c}", f"5 unit{c}", f"7 F{c}hig", c)] + [None, "a|b|c|d"]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (n INT, content VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want = dict(con.execute(f"SELECT n, {retrieval._POINTS} FROM t").fetchall())
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, content string")
    assert {r[0]: r[1] for r in rows.select("n", hybrid.structure_points(F.col("content"))).collect()} == want


def test_text_index_tasks_follow_the_documents(spark, monkeypatch):
    docs = retrieval.chunks(spark, SF).select("chunk_id", "patient_id", "content")
    asked = retrieval.queries(spark, SF)
    want = sorted(map(tuple, fulltext.search(fulltext.build(docs, {"content": 2.0}), asked, 10, 6).collect()))
    monkeypatch.setattr(fulltext, "TASK_DOCS", 10)
    monkeypatch.setattr(fulltext, "TASK_PAIRS", 400)
    index = fulltext.build(docs, {"content": 2.0})
    # A fixed number of documents a task, and no shuffle of words behind it.
    assert index.postings._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert index.postings.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, fulltext.search(index, asked, 10, 6).collect())) == want


def test_postings_are_dealt_before_they_meet_the_queries(spark):
    docs = retrieval.chunks(spark, SF).select("chunk_id", "patient_id", "content")
    found = fulltext.search(fulltext.build(docs, {"content": 2.0}), retrieval.queries(spark, SF), 10, 6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # What is shuffled by document lies below the join to the queries' terms, so that no row a query and posting is.
    assert plan.index("Join Inner, (term#") < plan.index("RepartitionByExpression [doc_id#")


def test_cells_are_scored_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(vector_cells, "BATCH_SCORES", 12)
    centres = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]])
    vectors = [[3.0, 1.0], [0.0, 0.0], None, [1.0], [1.0, 4.0], [-2.0, 1.0], [2.0, 2.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(vectors, pa.list_(pa.float64())), pa.array([None] * 7, pa.string())], names=["id", "vector", "scope"])
    out = list(vector_cells._cells_of(centres, 2)([batch]))
    assert max(b.num_rows for b in out) == 3  # 12 scores against 4 centres
    assert [r for b in out for r in b.column("id").to_pylist()] == list(range(7))
    assert [r for b in out for r in b.column("cells").to_pylist()] == [[0, 1], [-1], [-1], [-1], [1, 0], [2, 1], [0, 1]]
    assert not list(vector_cells._cells_of(centres, 2)([batch.slice(0, 0)]))


def _spans(items, texts):
    index, out = decontaminate.Index(items), [[] for _ in texts]
    for first, data, offsets in slices(pa.array(texts, pa.string())):
        for row, *found in index.search(decontaminate._FOLD[data], offsets).T.tolist():
            out[first + row].append(tuple(found))
    return [[tuple(m.values()) for m in decontaminate._merge(f)] for f in out]


def test_spans_follow_no_limit_of_size(monkeypatch):
    r = np.random.default_rng(31)
    draw = lambda letters, n: "".join(r.choice(list(letters), n))
    word = "abcdefghijklmnop qrst"
    items = [(1, draw(word, 400)), (2, draw("--------ab ", 130)), (3, draw("------ab ", 70)), (4, "-" * 120), (5, draw(word, 96))]
    cell = items[0][1]
    texts = [
        # Passages of one item: at half-overlapping windows, at another offset, and twice the same.
        draw(word, 300) + cell[:200] + draw(word, 333) + cell[217:320] + draw(word, 250) + cell[:200],
        (items[1][1] + "x" * 57) * 20 + items[2][1] + "-" * 900 + "ab " + items[2][1],
        draw("--------ab ", 400) + items[1][1] + draw("--------ab ", 300) + cell[5:110] + items[4][1],
        "-" * 1500,
    ]
    want = _spans(items, texts)
    assert [m[0] for m in want[0]] == [1, 1, 1] and [m[0] for m in want[1]].count(2) == 20 and [m[0] for m in want[3]] == [4]
    for hits, part, stretch in ((300, 100, 1 << 20), (2_000_000, 16_384, 200), (300, 16_384, 500)):
        monkeypatch.setattr(decontaminate, "MAX_HITS", hits)
        monkeypatch.setattr(decontaminate, "PART_BYTES", part)
        monkeypatch.setattr(decontaminate, "STRETCH", stretch)
        assert _spans(items, texts) == want and [x for t in texts for x in _spans(items, [t])] == want
        one_by_one = [_spans([i], texts) for i in items]
        assert [sorted(m for one in one_by_one for m in one[t]) for t in range(len(texts))] == want


def test_index_splits_texts_once(spark):
    docs = retrieval.chunks(spark, SF).select("chunk_id", "patient_id", "content")
    plan = fulltext.build(docs, {"content": 2.0}).postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1


def test_upkeep_counts_of_many_ids_come_from_stored_rows(spark, tmp_path, monkeypatch):
    docs = retrieval.chunks(spark, SF).select("chunk_id", "patient_id", "content")
    vectors = retrieval.vectors(spark, SF).select("chunk_id", "embedding")
    gone = docs.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("id"))
    index = upkeep.LiveIndex.create(spark, f"file://{tmp_path}/live", docs, vectors, {"content": 1.0})
    segments = index._state()["segments"]
    rows = []
    for listed in (1000, 3):
        monkeypatch.setattr(upkeep, "LISTED_IDS", listed)
        dropped = index._dropped(segments, gone, {"content": 1.0}, False)
        rows.append([sorted(map(tuple, x.select(c).collect())) for x, c in zip(dropped, (["doc_id", "term", "weight", "length"], ["doc_id", "length"]))])
        plan = dropped[0]._jdf.queryExecution().toString()
        assert ("split" in plan) == (listed == 1000)
        index.delete(gone.withColumnRenamed("id", "chunk_id")) if listed == 3 else None
    assert rows[0] == rows[1] and rows[0][0]
    left = fulltext.build(docs.where("chunk_id % 3 != 0"), {"content": 1.0})
    live = index.open().text
    assert sorted(map(tuple, live.frequencies.collect())) == sorted(map(tuple, left.frequencies.collect()))
    assert live.stats.first() == left.stats.first()
