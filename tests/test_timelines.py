"""As-of and interval joins, episodes, frames, batches and order statistics against plain Python, with a hot key, nulls and ties."""

import collections
import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom import catalog
from chartloom.operators import batching, intent, order_statistic, timelines

BASE = datetime.datetime(2024, 1, 1)
EVENTS = "id bigint, who string, at timestamp, value bigint"


def events(n, seed, hot=0.5, span=400, null=True):
    """Half of the rows belong to one key; some keys and times are null."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        who = "hot" if r.random() < hot else f"p{r.randrange(8)}"
        at = BASE + datetime.timedelta(days=r.randrange(span), hours=r.choice([0, 0, 5, 12]))
        out.append((i, None if null and r.random() < 0.03 else who, None if null and r.random() < 0.03 else at, None if r.random() < 0.1 else r.randrange(100)))
    return out


def test_as_of_join(spark):
    left, right = events(400, 1), events(150, 2, span=300)
    right += right[:5]
    got = timelines.as_of_join(spark.createDataFrame(left, EVENTS), spark.createDataFrame(right, EVENTS), "who", "at", "at", "id", days=20)
    assert got.columns == ["id", "who", "at", "value", "right"]
    want = {}
    for i, who, at, _ in left:
        before = [(t, j) for j, w, t, _ in right if w is not None and w == who and t is not None and at is not None and t <= at]
        want[i] = max(before)[1] if before else None
    assert {r["id"]: r["right"] and r["right"]["id"] for r in got.collect()} == want and len(want) == got.count() and sum(v is not None for v in want.values()) > 200


def test_overlaps(spark):
    def intervals(n, seed):
        r = random.Random(seed)
        return [(i, w, t, t and t + datetime.timedelta(days=r.choice([-3, 0, 1, 10, 10, 70]))) for i, w, t, _ in events(n, seed, span=200)]

    a, b = intervals(150, 3), intervals(120, 4)
    kind = "id bigint, who string, begins timestamp, ends timestamp"
    got = timelines.overlaps(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), "who", "begins", "ends", days=15)
    want = collections.Counter((x[0], y[0]) for x in a for y in b if x[1] and x[1] == y[1] and x[2] and y[2] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert collections.Counter((r["left"]["id"], r["right"]["id"]) for r in got.collect()) == want and len(want) > 300


@pytest.mark.parametrize("days", [1, 7, 60])
def test_episodes(spark, days):
    rows = events(300, 5, span=900)
    want, by = [], collections.defaultdict(list)
    for _, who, at, _ in rows:
        if who and at:
            by[who].append(at)
    for who, times in by.items():
        run = []
        for t in sorted(times):
            if run and t - run[-1] > datetime.timedelta(days=5):
                want.append((who, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((who, run[0], run[-1], len(run)))
    assert sorted(map(tuple, timelines.episodes(spark.createDataFrame(rows, EVENTS), "who", "at", 5, days).collect())) == sorted(want)


def test_trailing(spark):
    rows = events(400, 6, span=120)
    want = {}
    for i, who, at, _ in rows:
        mine = [v for _, w, t, v in rows if who and w == who and at and t and at - datetime.timedelta(days=10) <= t <= at]
        known = [v for v in mine if v is not None]
        want[i] = (len(mine) if who and at else None, sum(known) if known else None)
    got = timelines.trailing(spark.createDataFrame(rows, EVENTS), "who", "at", "value", 10)
    assert {r["id"]: (r["trailing_n"], r["trailing_sum"]) for r in got.collect()} == want


def test_no_key_meets_in_one_task(spark):
    """A hot patient's rows are dealt by key and slice; only one row a slice is ordered by key alone."""
    one = spark.createDataFrame(events(10, 1), EVENTS)
    plan = timelines.as_of_join(one, one, "who", "at", "at", "id")._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window ") and "__slice" not in line.split("windowspecdefinition(")[1].split("ASC")[0]]
    assert len(alone) <= 1


@pytest.mark.parametrize("most", [0, 60, 10**9])
def test_as_of_join_of_crowded_keys(spark, monkeypatch, most):
    """Every key cut into slices, the hot one only, none: the same rows; a hot key's rows are then dealt by slice as well."""
    monkeypatch.setattr(timelines, "KEY_ROWS", most)
    left, right = events(300, 7), events(200, 8, span=300)
    a, b = (spark.createDataFrame(x, EVENTS) for x in (left, right))
    crowded = timelines._crowded(a, b, "who")
    assert len(crowded) == {0: 9, 60: 1, 10**9: 0}[most]
    found = timelines.as_of_join(a, b, "who", "at", "at", "id", days=20, take=["value"])
    want = []
    for i, who, at, v in left:
        before = [(t, j, x) for j, w, t, x in right if w is not None and w == who and t is not None and at is not None and t <= at]
        want.append((i, who, at, v, (max(before)[2],) if before else None))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == want
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "rowframe" in line.lower() and "__here" in line.split(" AS ")[-1]]
    assert windows and all(("__slice" in line) == bool(crowded) for line in windows)


def test_as_of_join_shuffles_its_rows_once(spark):
    """Rows go to their key once, with the columns that are asked for."""
    plan = catalog.QUERIES["medication_at_record"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Exchange ") == 1 and "p_name" not in plan and "l_quantity" not in plan


def test_empty_timelines(spark):
    none = spark.createDataFrame([], EVENTS)
    assert timelines.as_of_join(none, none, "who", "at", "at", "id").count() == 0 and timelines.episodes(none, "who", "at", 3).count() == 0
    assert timelines.trailing(none, "who", "at", "value", 3).count() == 0 and timelines.overlaps(none, none, "who", "at", "at").count() == 0


# Batches


def greedy(lines, limit):
    out, total, batch = [], 0, -1
    for line in lines:
        n = len(line) + 1
        if batch < 0 or total + n > limit:
            batch, total = batch + 1, 0
        total += n
        out.append(batch)
    return out


def test_runs_of_one_list():
    r = random.Random(2)
    for _ in range(2000):
        sizes = [r.choice([0, 1, 2, 5, 9, 30]) for _ in range(r.randrange(40))]
        limit, want, total = r.randrange(1, 25), [], None
        for i, n in enumerate(sizes):
            if total is None or total + n > limit:
                want.append(i)
                total = 0
            total += n
        assert batching.greedy_starts(np.array(sizes, np.int64), limit) == want


@pytest.mark.parametrize("part", [7, 40, 10_000])
def test_batches_over_parts(spark, monkeypatch, part):
    """Groups that span parts, end in them, are null or of one line; lines over the limit."""
    monkeypatch.setattr(batching, "PART_LINES", part)
    monkeypatch.setattr(batching, "PART_LIMITS", 0)
    r = random.Random(part)
    rows = [(g, i, "x" * r.choice([0, 3, 3, 8, 15, 40])) for g, n in (("a", 150), ("b", 1), (None, 30), ("", 45), ("c", 90)) for i in range(n)]
    shuffled = list(rows)
    r.shuffle(shuffled)
    got = {(x["who"], x["nr"]): x["batch"] for x in intent.batch_lines(spark.createDataFrame(shuffled, "who string, nr int, line string"), 30, "who", "nr").collect()}
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: x[1])
        assert [got[g, x[1]] for x in mine] == greedy([x[2] for x in mine], 30), g
    assert intent.batch_lines(spark.createDataFrame([], "who string, nr int, line string"), 30, "who", "nr").count() == 0


def test_a_long_group_takes_seconds(spark):
    n = 100_000
    lines = spark.range(n).select(F.col("id").alias("nr"), F.repeat(F.lit("x"), (F.xxhash64("id") % 40 + 40).cast("int")).alias("line"))
    want = greedy([x["line"] for x in lines.orderBy("nr").collect()], 400)
    began = time.time()
    got = intent.batch_lines(lines, 400, None, "nr").collect()
    assert time.time() - began < 60
    assert [x["batch"] for x in sorted(got, key=lambda x: x["nr"])] == want
    sizes = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 50).alias("s"))
    began = time.time()
    runs = sizes.select(batching.pack(F.col("s"), F.lit(400))).first()[0]
    assert time.time() - began < 20 and sum(x["n"] for x in runs) == n


def test_batched_records(spark):
    sf = "/root/testdata/sf0.001"
    got = collections.defaultdict(dict)
    for r in catalog.QUERIES["batched_records"](spark, sf).collect():
        got[r["patient_id"]][r["record_id"]] = r["batch"]
    lines = collections.defaultdict(dict)
    from chartloom.sources.clinic import load

    for r in load(spark, sf, "record").select("patient_id", "record_id", F.concat_ws(" — ", "condition_name", "status", "severity").alias("line")).collect():
        lines[r["patient_id"]][r["record_id"]] = r["line"]
    assert {p: list(x) for p, x in got.items()}.keys() == lines.keys()
    for p, x in lines.items():
        ids = sorted(x)
        assert [got[p][i] for i in ids] == greedy([x[i] for i in ids], 400)


# Order statistics


@pytest.mark.parametrize("kind", ["uniform", "heavy", "two", "one", "far", "ends"])
def test_every_rank(spark, monkeypatch, kind):
    monkeypatch.setattr(order_statistic, "FEW", 5)
    monkeypatch.setattr(order_statistic, "ACCURACY", 50)
    g = np.random.default_rng(3)
    values = {"uniform": g.random(800), "heavy": g.pareto(0.3, 800), "two": g.choice([1.0, 2.0], 300), "one": np.full(50, 3.0), "far": np.r_[g.random(500) * 1e-9, 1e300, -1e300], "ends": np.r_[np.zeros(400), g.random(9), np.ones(400)]}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").persist()
    want = np.sort(values)
    for rank in sorted({0, 1, len(want) // 3, len(want) // 2, int(len(want) * 0.95), len(want) - 1}):
        assert order_statistic.nth(df, "x", rank) == want[rank]
    assert order_statistic.nth(df, "x", len(want)) is None and order_statistic.nth(df, "x", -1) is None
    df.unpersist()
