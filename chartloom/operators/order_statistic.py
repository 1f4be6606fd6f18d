"""Exact order statistics by narrowing: no column is sorted and no value decides where the work goes.

A sketch of the values in question gives two of them around the wanted rank;
counting says whether the rank lies between them, and the values outside go.
Each step leaves about one value in a thousand, however they are spread; when
few different ones are left they are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many different values at most are looked at one by one.
FEW = 4096
#: The sketch is off by at most this share of the ranks.
ACCURACY = 2000


def nth(df: DataFrame, column: str, rank: int):
    """The value at ``rank`` (from 0) of the sorted non-null values; None if there are not so many.

    Reads the column once or twice a step; keep it in a table of its own if it is
    costly to compute.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    n, before = values.count(), 0
    if not 0 <= rank < n:
        return None
    while True:
        few = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).limit(FEW + 1).collect() if n <= FEW * ACCURACY else []
        if 0 < len(few) <= FEW:
            for r in sorted(few, key=lambda r: r["v"]):
                before += r["c"]
                if rank < before:
                    return r["v"]
        share, slack = (rank - before) / n, 2 / ACCURACY
        low, high = values.agg(F.percentile_approx("v", [max(share - slack, 0.0), min(share + slack, 1.0)], ACCURACY)).first()[0]
        under, upto = values.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") <= high)).first()
        if before + under <= rank < before + upto:
            if low == high:
                return low
            kept = (F.col("v") >= low) & (F.col("v") <= high)
            if upto - under == n:
                # Only the two ends are heavy: one of them, or what lies between.
                at_low, below_high = values.agg(F.count_if(F.col("v") == low), F.count_if(F.col("v") < high)).first()
                if rank < before + at_low:
                    return low
                if rank >= before + below_high:
                    return high
                kept, under, upto = (F.col("v") > low) & (F.col("v") < high), at_low, below_high
            before, n, values = before + under, upto - under, values.where(kept)
        elif rank < before + under:
            values, n = values.where(F.col("v") < low), under
        else:
            values, before, n = values.where(F.col("v") > high), before + upto, n - upto
