"""As-of and interval joins, episodes and trailing frames over a patient's events (JON-11, WIN-05).

A patient may have any share of the rows, so nothing here puts a patient with
very many into one task: rows are dealt by key and time slice, and what a slice
must know of others crosses as one row a key and slice (the last value before it,
the islands at its edges) or as the neighbouring slice's rows.

Times are timestamps; rows whose key or time is null take no part, but rows of
the left side stay in the as-of join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The width of a time slice, in days.
SLICE_DAYS = 30
#: A key with more rows than this is cut into slices by the as-of join.  Rows are counted by the key's hash in so many buckets, so that counting shuffles and collects little.
KEY_ROWS, BUCKETS = 1 << 18, 1 << 16
_DAY = 86_400_000_000


def micros(time: Column | str) -> Column:
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def _slice(at: Column, days: int) -> Column:
    return F.floor(at / F.lit(days * _DAY))


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _crowded(left: DataFrame, right: DataFrame, key: str) -> list[int]:
    """Numbers of the buckets of keys with more than KEY_ROWS rows of both sides; a key with more is in one of them."""
    buckets = [df.where(F.col(key).isNotNull()).select(_bucket(key).alias("bucket")) for df in (left, right)]
    counts = buckets[0].unionAll(buckets[1]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return [r["bucket"] for r in counts.where(F.col("n") > KEY_ROWS).select("bucket").collect()]  # BUCKETS numbers at most


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, order: str, days: int = SLICE_DAYS, take: list[str] | None = None) -> DataFrame:
    """``left`` with ``right``: a struct of the latest right row of the key at or before the left time, null where there is none.

    Of right rows at one time the one with the greatest ``order`` counts; the
    struct has the columns ``take`` (all, if not given).  Both sides go into one
    union, which is shuffled once by key; the last right row so far is a running
    window.  Only keys with very many rows are dealt by slices of ``days``, too,
    and the last row of all their earlier slices is carried in.
    """
    take = right.columns if take is None else take
    taken = F.struct(*dict.fromkeys([*take, order]))  # what is sorted by lies in it already
    rows = left.select(F.col(key).alias("__key"), micros(left_time).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(taken.alias("r")).schema["r"].dataType).alias("__right"))
    known = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    other = known.select(F.col(key).alias("__key"), micros(right_time).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(rows.schema["__left"].dataType).alias("__left"), taken.alias("__right"))
    # Left rows without a key or time have no partner and no slice.
    idle = F.col(key).isNull() | F.col(left_time).isNull()
    both = rows.where("__key is not null and __at is not null").unionByName(other)
    crowded = _crowded(left.where(~idle), known, key)
    together = ["__key", "__slice"] if crowded else ["__key"]
    if crowded:
        both = both.withColumn("__slice", F.when(_bucket("__key").isin(crowded), _slice(F.col("__at"), days)))  # null: the key is whole
    in_turn = ("__at", "__side", F.col("__right")[order])
    so_far = Window.partitionBy(*together).orderBy(*in_turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__here", F.last("__right", ignorenulls=True).over(so_far)).where("__side = 1")
    latest = F.col("__here")
    if crowded:
        is_right = F.col("__side") == 0
        slices = both.where("__slice is not null").groupBy(*together).agg(F.max_by(F.when(is_right, F.col("__right")), F.when(is_right, F.struct("__at", F.col("__right")[order]))).alias("__last"))
        earlier = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a key and slice
        carried = slices.select(*together, F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
        found, latest = found.join(carried, together, "left"), F.coalesce("__here", "__carried")
    wanted = latest if set(take) == {*take, order} else F.when(latest.isNotNull(), F.struct(*[latest[c].alias(c) for c in take]))
    joined = found.select("__left.*", wanted.alias("right"))
    return joined.unionByName(left.where(idle).withColumn("right", F.lit(None).cast(joined.schema["right"].dataType)))


def overlaps(a: DataFrame, b: DataFrame, key: str, start: str, end: str, days: int = SLICE_DAYS) -> DataFrame:
    """Pairs (``left``, ``right``: structs) of rows of one key whose intervals [start, end] share a moment.

    Intervals meet in the slices that they touch, and a pair is kept in the first
    slice that both touch.  An interval of n slices is n rows; choose ``days`` near
    the usual length.  Intervals that end before they start, or lack an end, share
    none.
    """

    def touched(df: DataFrame, side: str) -> DataFrame:
        known = df.where(F.col(key).isNotNull() & (micros(start) <= micros(end)))
        return known.select(F.col(key).alias("__key"), micros(start).alias(f"__{side}_from"), micros(end).alias(f"__{side}_to"), F.struct(*df.columns).alias(side), F.explode(F.sequence(_slice(micros(start), days), _slice(micros(end), days))).alias("__slice"))

    pairs = touched(a, "left").join(touched(b, "right"), ["__key", "__slice"])
    meet = (F.col("__left_from") <= F.col("__right_to")) & (F.col("__right_from") <= F.col("__left_to"))
    first = F.col("__slice") == _slice(F.greatest("__left_from", "__right_from"), days)
    return pairs.where(meet & first).select("left", "right")


def _islands(rows: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Merge (from, to, n) rows, none of which lies inside another, where they follow within the gap."""
    w = Window.partitionBy(*by).orderBy("from", "to")
    numbered = rows.withColumn("__new", F.coalesce((F.col("from") - F.lag("to").over(w) > gap).cast("int"), F.lit(1))).withColumn("__island", F.sum("__new").over(w))
    return numbered.groupBy(*by, "__island").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.sum("n").alias("n")).drop("__island")


def episodes(events: DataFrame, key: str, time: str, gap_days: int, days: int = SLICE_DAYS) -> DataFrame:
    """(key, first_event, last_event, events): stretches of a key's events without a gap of over ``gap_days``.

    Islands of each slice first, then those of all slices of a key, which are
    few: a slice of ``days`` has an island for each gap that fits into it, so
    slices much shorter than the gap have one.
    """
    known = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    at = micros(time)
    rows = known.groupBy(F.col(key).alias("key"), _slice(at, days).alias("slice"), at.alias("from")).agg(F.count(F.lit(1)).alias("n")).withColumn("to", F.col("from"))
    parts = _islands(rows, ["key", "slice"], gap_days * _DAY)
    whole = _islands(parts, ["key"], gap_days * _DAY)
    return whole.select(F.col("key").alias(key), F.timestamp_micros("from").alias("first_event"), F.timestamp_micros("to").alias("last_event"), F.col("n").alias("events"))


def trailing(events: DataFrame, key: str, time: str, value: str, frame_days: int) -> DataFrame:
    """``events`` with ``trailing_n`` and ``trailing_sum`` of ``value`` over the key's events of the last ``frame_days``, the row's own moment included.

    Slices are as wide as the frame, so a row needs its own slice and the one
    before; each row is in two slices, and is kept in its own.
    """
    width = frame_days * _DAY
    at = micros(time)
    rows = events.select(F.col(key).alias("__key"), at.alias("__at"), F.col(value).alias("__value"), F.struct(*events.columns).alias("__row"))
    known = rows.where("__key is not null and __at is not null").withColumn("__own", F.floor(F.col("__at") / width))
    both = known.withColumn("__slice", F.explode(F.array("__own", F.col("__own") + 1)))
    frame = Window.partitionBy("__key", "__slice").orderBy("__at").rangeBetween(-width, Window.currentRow)
    framed = both.withColumn("trailing_n", F.count(F.lit(1)).over(frame)).withColumn("trailing_sum", F.sum("__value").over(frame)).where("__slice = __own")
    none = rows.where("__key is null or __at is null").select("__row.*", F.lit(None).cast("bigint").alias("trailing_n"), F.lit(None).cast(framed.schema["trailing_sum"].dataType).alias("trailing_sum"))
    return framed.select("__row.*", "trailing_n", "trailing_sum").unionByName(none)
