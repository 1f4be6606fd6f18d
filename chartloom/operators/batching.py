"""Greedy batches of lines, for groups of any length (CHK-04, RTR-05).

A line that would take its batch over the limit starts the next one, so where a
batch starts depends on all lines before it.  Sorted lines are cut into parts.
For a part, what it does with the batch that is open at its first line follows
from the first place where it breaks; there are few such places, as the lines
before one fit into a single batch.  Each part tells for each of them which
batch is open at its end; following that from part to part gives every part's
entry, and then the parts batch their lines side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.sources import versions

#: Lines of a part, or PART_LIMITS times the limit if that is more: then what parts tell is a small share of the lines.
PART_LINES = 50_000
PART_LIMITS = 64
RUNS = "array<struct<first: int, n: int, total: int>>"


def next_breaks(sizes: np.ndarray, new: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(before, next): the size before each line and at the end, and where the batch that starts at a line is followed by another; ``new`` are forced starts."""
    n = len(sizes)
    before = np.r_[0, np.cumsum(sizes)]
    full = np.maximum(np.searchsorted(before, before[:-1] + limit, "right") - 1, np.arange(1, n + 1))
    forced = np.r_[np.flatnonzero(new), n]
    return before, np.minimum(full, forced[np.searchsorted(forced, np.arange(n), "right")])


def greedy_starts(sizes: np.ndarray, limit: float) -> list[int]:
    """Where the batches of one list start."""
    follows = next_breaks(sizes, np.zeros(len(sizes), bool), limit)[1].tolist()
    starts, at = [], 0
    while at < len(follows):
        starts.append(at)
        at = follows[at]
    return starts


def _runs(sizes, limits):
    import pyarrow as pa

    out = []
    for s, limit in zip(sizes.to_pylist(), limits.to_pylist()):
        if s is None or limit is None:
            out.append(None)
            continue
        s = np.asarray(s, np.int64)
        starts = greedy_starts(s, limit)
        ends = [*starts[1:], len(s)]
        out.append([{"first": a, "n": b - a, "total": int(s[a:b].sum())} for a, b in zip(starts, ends)])
    return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("total", pa.int32())])))


def pack(sizes: Column, limit: Column) -> Column:
    """Runs (first, n, total) of the lines of one array by their sizes; linear in its length.  Null for a null array or limit."""
    return F.arrow_udf(_runs, RUNS)(F.transform(sizes, lambda x: x.cast("bigint")), limit.cast("double"))


def _shape(part: pd.DataFrame, limit: float):
    """(before, follows, new) of a part's sorted lines; ``new`` where another group begins."""
    group = part["group"].to_numpy()
    new = np.r_[False, group[1:] != group[:-1]]
    before, follows = next_breaks(part["size"].to_numpy(np.int64), new, limit)
    return before, follows.tolist(), new


def _tell(limit: float):
    """Of a part: for each place where it can first break, the size with that line, what is then open at the end, and how many batches the last group has."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        before, follows, new = _shape(part, limit)
        n, forced = len(part), np.flatnonzero(new)
        begin = int(forced[-1]) if len(forced) else 0
        last, count = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            j = follows[i]
            last[i], count[i] = (i, 0) if j == n else (last[j], count[j])
            count[i] += i >= begin
        stop = min(int(forced[0]) if len(forced) else n, int(np.searchsorted(before, limit, "right")) - 1, n - 1)
        rows = [(i, int(before[i + 1]), int(before[n] - before[last[i]]), count[i]) for i in range(stop + 1)]
        if not len(forced) and before[n] <= limit:
            rows.append((n, 0, int(before[n]), 0))
        told = pd.DataFrame(rows, columns=["first", "with_line", "open", "batches"])
        return told.assign(part=part["part"].iloc[0], lines=n, forced=int(forced[0]) if len(forced) else -1, first_group=part["group"].iloc[0], last_group=part["group"].iloc[-1])

    return run


_TOLD = "first int, with_line bigint, open bigint, batches bigint, part int, lines int, forced int, first_group string, last_group string"


def _entries(told: DataFrame, limit: float) -> list[tuple[int, int, int]]:
    """(part, first break, batch that is open before it) of every part; -1 where its first line begins a group."""
    out, group, open_, batch, part, rows = [], None, 0, -1, None, []

    def follow() -> None:
        nonlocal group, open_, batch
        head = rows[0]
        goes_on = bool(out) and head["first_group"] == group
        entry = batch if goes_on else -1
        chosen = next((r for r in rows if r["first"] == head["lines"] or r["first"] == head["forced"] or open_ + r["with_line"] > limit), None) if goes_on else rows[0]
        out.append((part, chosen["first"], entry))
        if chosen["first"] == head["lines"]:
            open_ += chosen["open"]
        else:
            batch = chosen["batches"] - 1 + (entry + 1 if head["forced"] < 0 else 0)
            open_ = chosen["open"]
        group = head["last_group"]

    for r in told.orderBy("part", "first").toLocalIterator():
        if r["part"] != part and rows:
            follow()
            rows = []
        part = r["part"]
        rows.append(r)
    if rows:
        follow()
    return out


def _number(limit: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        _, follows, new = _shape(part, limit)
        n, at, batch = len(part), int(part["first"].iloc[0]), int(part["entry"].iloc[0])
        numbers = np.full(n, batch, np.int64)
        while at < n:
            batch = 0 if new[at] else batch + 1
            numbers[at : follows[at]] = batch
            at = follows[at]
        return pd.DataFrame({"part": part["part"], "place": part["place"], "batch": numbers.astype(np.int32)})

    return run


def batches(lines: DataFrame, size: Column, limit: float, group: str | None, *order: str) -> DataFrame:
    """``lines`` with ``batch``, from 0 in each group: greedy, in order, of at most ``limit`` in size; a larger line is a batch of its own.

    Groups may be null and of any length.  Lines of a group that agree in all of
    ``order`` follow one another in some order.  The sorted lines are written to
    the shared folder once; what parts tell, at most a number or two for each line
    that fits into one batch, passes the driver one part after the other.
    """
    spark = lines.sparkSession
    key = F.to_json(F.struct(group)) if group else F.lit("")
    rows = lines.select(F.struct(*lines.columns).alias("line"), key.alias("group"), size.cast("bigint").alias("size"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(order)])
    by = ["group", *[f"by{i}" for i in range(len(order))], "chance"]
    parts = max(1, -(-rows.count() // max(PART_LINES, int(PART_LIMITS * limit))))
    ranged = rows.withColumn("chance", F.rand(1)).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    numbered = ranged.select("line", "group", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    stored = versions.stored(numbered, versions.scratch(spark, "lines"))
    narrow = stored.select("part", "place", "group", "size")
    told = versions.stored(narrow.groupBy("part").applyInPandas(_tell(limit), _TOLD), versions.scratch(spark, "told"))
    entries = spark.createDataFrame(_entries(told, limit), "part int, first int, entry bigint")
    found = narrow.join(entries, "part").groupBy("part").applyInPandas(_number(limit), "part int, place bigint, batch int")
    return stored.join(found, ["part", "place"]).select("line.*", "batch")
