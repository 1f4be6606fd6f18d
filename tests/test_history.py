"""Rollups, sketches, differences, pages and the live view against exact values and batch queries."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from chartloom.operators import chart, rollups
from chartloom.sources import history, versions
from chartloom.streaming import incremental, live_view

EVENTS = "day timestamp, kind string, who string, value double"


def visits(spark, n, seed, days=30):
    r = random.Random(seed)
    rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(days=r.randrange(days), hours=3), r.choice(["a", "a", "a", "b", None]), r.choice([None, *(f"p{i}" for i in range(900))]), r.choice([None, r.paretovariate(1)])) for _ in range(n)]
    return spark.createDataFrame([*rows, (None, "a", "p1", 1.0)], EVENTS)


def test_rollup_levels(spark):
    """A null value of a dimension is no subtotal."""
    got = {(r["kind"], r["who"], r["level"]): r["n"] for r in rollups.rolled_up(spark.createDataFrame([("a", "x"), ("a", None), (None, None)], "kind string, who string"), ["kind", "who"], F.count("*").alias("n")).collect()}
    assert got == {("a", "x", 0): 1, ("a", None, 0): 1, (None, None, 0): 1, ("a", None, 1): 2, (None, None, 1): 1, (None, None, 3): 3}


def test_sketches_merge_within_their_error(spark, tmp_path):
    events, path = visits(spark, 20_000, 1).persist(), f"file://{tmp_path}/days"
    rollups.store_days(rollups.sketched(events, "day", ["kind"], "who", "value"), path)
    got = rollups.merged(rollups.stored_days(spark, path), "kind").select("kind", "events", "value_sum", rollups.distinct_keys().alias("keys"), rollups.quantile(0.5).alias("p50"), rollups.quantile(0.95).alias("p95")).collect()
    assert {r["kind"] for r in got} == {"a", "b", None}
    for r in got:
        rows = [x for x in events.collect() if x["kind"] == r["kind"] and x["day"]]
        values = sorted(x["value"] for x in rows if x["value"] is not None)
        exact = len({x["who"] for x in rows} - {None})
        assert r["events"] == len(rows) and r["value_sum"] == pytest.approx(sum(values))
        assert abs(r["keys"] - exact) <= 4 * rollups.DISTINCT_ERROR * exact
        for name, share in (("p50", 0.5), ("p95", 0.95)):
            rank = sum(v <= r[name] for v in values) / len(values)
            assert abs(rank - share) <= 3 * rollups.RANK_ERROR, (name, rank)
    events.unpersist()


def test_a_day_is_replaced_alone(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    make = lambda day, n: spark.createDataFrame([(datetime.datetime(2024, 1, day), "a", f"p{i}", float(i)) for i in range(n)], EVENTS)
    rollups.store_days(rollups.sketched(make(1, 5).unionByName(make(2, 6)), "day", [], "who", "value"), path)
    rollups.store_days(rollups.sketched(make(2, 9).unionByName(make(3, 1)), "day", [], "who", "value"), path)
    got = {r["day"].day: (r["events"], r["n"]) for r in rollups.stored_days(spark, path).select("day", "events", rollups.distinct_keys().alias("n")).collect()}
    assert got == {1: (5, 5), 2: (9, 9), 3: (1, 1)}
    part = rollups.stored_days(spark, path, "2024-01-02", "2024-01-02")
    assert rollups.merged(part).first()["events"] == 9 and "PartitionFilters: [isnotnull(day" in part._jdf.queryExecution().toString()
    none = rollups.merged(rollups.sketched(make(1, 0), "day", [], "who", "value"), "day")
    assert none.count() == 0


ROWS = "id bigint, a string, b double, c array<int>"


def test_diff_and_patch(spark):
    old = [(1, "x", 1.0, [1]), (2, None, 1.0, None), (3, "", None, []), (4, "same", 0.5, [1, 2]), (None, "null key", 1.0, None), (7, "a", 1.0, None)]
    new = [(1, "x", 2.0, [1]), (2, "", 1.0, None), (3, "", None, [None]), (4, "same", 0.5, [1, 2]), (None, "null key!", 1.0, None), (8, "new", None, None)]
    a, b = spark.createDataFrame(old, ROWS), spark.createDataFrame(new, ROWS)
    d = history.diff(a, b, "id")
    got = {r["id"]: (r["change"], r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in d.collect()}
    o, n = {x[0]: x for x in old}, {x[0]: x for x in new}
    assert got == {1: ("changed", o[1], n[1]), 2: ("changed", o[2], n[2]), 3: ("changed", o[3], n[3]), None: ("changed", o[None], n[None]), 7: ("removed", o[7], None), 8: ("added", None, n[8])}
    order = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert order(history.apply_diff(a, d, "id")) == order(b)
    assert order(history.except_rows(b.unionByName(b), a)) == order(b.exceptAll(a.where("id = 4")))
    assert history.diff(a, a, "id").count() == 0 and history.diff(a, a.limit(0), "id").count() == len(old)


@pytest.mark.parametrize("offset", [0, 1, 499, 995, 1000, 5000])
def test_pages(spark, offset):
    rows = [(i * 7919 % 1000, f"v{i}") for i in range(1000)]
    pages = history.Pages.of(spark.createDataFrame(rows, "n int, v string").repartition(5), "n")
    assert len(pages) == 1000
    got = sorted((r["position"], r["n"], r["v"]) for r in pages.page(offset, 30).collect())
    assert got == [(i, n, v) for i, (n, v) in enumerate(sorted(rows))][offset : offset + 30]
    assert history.Pages.of(spark.createDataFrame([], "n int, v string"), "n").page(0, 5).count() == 0


def test_live_view_follows_a_stream(spark, tmp_path):
    """After each micro-batch the view equals the batch query, whatever the order, repeats and restarts."""
    r = random.Random(6)
    path, check, source = (f"file://{tmp_path}/{n}" for n in ("view", "check", "in"))
    statuses = ["Completed", "In Exam", "Waiting triage", "Checked In", "Scheduled", None]
    latest, version = {}, 0
    for batch in range(6):
        rows = []
        for _ in range(60):
            i = f"v{r.randrange(70)}"
            version += 1
            at = r.choice([None, datetime.datetime(2024, 3, 1 + r.randrange(3), 9)])
            row = (i, r.choice([None, "p1", "p2", "p3"]), at, r.choice(statuses), version, r.random() < 0.15)
            rows.append(row)
            latest[i] = row
        late = [(i, "late", datetime.datetime(2024, 3, 1), "Completed", 0, False) for i in list(latest)[:3]]
        spark.createDataFrame([*rows, *rows[:4], *late, (None, "p", None, None, 1, False), ("v", "p", None, None, None, False)], live_view.CHANGE).write.parquet(f"{source}/{batch}")
        changes = spark.readStream.schema(live_view.CHANGE).option("recursiveFileLookup", "true").parquet(source)
        live_view.follow(changes, path, check).awaitTermination()  # a new query each time: it starts from the checkpoint
        if batch == 3:
            live_view.compact(spark, path)
            assert len(versions.folders(spark, path)) == 1
        there = spark.createDataFrame([x[:4] for x in latest.values() if not x[5]] or [(None,) * 4], "appointment_id string, patient_id string, scheduled_time timestamp, status string")
        for day in ("2024-03-01", "2024-03-02", "2024-03-03"):
            want = tuple(chart.agenda(there, f"{day} 12:00:00").first())
            got = live_view.figures(spark, path, day).drop("day").collect()
            assert (tuple(got[0]) if got else (0,) * 6) == want, (batch, day)
    live_view.compact(spark, path)
    live_view.compact(spark, path)
    assert sum(f["total"] for f in live_view.figures(spark, path).collect()) == sum(not x[5] and x[2] is not None for x in latest.values())


def test_a_kept_table_rewrites_touched_buckets_only(spark, tmp_path):
    """A stream of changes over restarts: the last change of a key wins, other buckets keep their files, replaced ones can go."""
    r, kind = random.Random(4), "key string, n int, at int"
    path, check, source = (f"file://{tmp_path}/{n}" for n in ("table", "check", "in"))
    for batch in range(4):
        keys = [f"k{i}" for i in range(200)] if batch == 0 else [f"k{r.randrange(220)}" for _ in range(3)]
        rows = [(k, r.randrange(100), 10 * batch + j % 10) for j, k in enumerate([*keys, *keys[:2]])] + [(f"k{batch}", -1, -5)]
        rows = [x for x in rows if sum(y[0] == x[0] and y[2] == x[2] for y in rows) == 1]
        spark.createDataFrame(rows, kind).write.parquet(f"{source}/{batch}")
        before = dict(versions.current(spark, path)["versions"]) if batch else {}
        changes = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(source)
        incremental.keep_table(changes, path, "key", "at", check, buckets=16).awaitTermination()
        after = dict(versions.current(spark, path)["versions"])
        changed = {b for b in after if before.get(b) != after[b]}
        assert len(changed) <= len({x[0] for x in rows}) and all(after[b] == batch for b in changed)
        want: dict = {}
        for seen in range(batch + 1):
            for x in spark.read.parquet(f"{source}/{seen}").collect():
                if x["key"] not in want or x["at"] > want[x["key"]][2]:
                    want[x["key"]] = tuple(x)
        assert sorted(map(tuple, incremental.kept_table(spark, path).select("key", "n", "at").collect())) == sorted(want.values())
    assert incremental.drop_replaced(spark, path) > 0
    assert sorted(map(tuple, incremental.kept_table(spark, path).select("key", "n", "at").collect())) == sorted(want.values())
