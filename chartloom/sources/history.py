"""What changed between two versions of a table, and pages of a sorted one (SET-05, SRT-05)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.sources import versions


def row_hash(columns: list[str]):
    """128 bits of a row; null, empty and missing values differ, and so does the place of a value."""
    whole = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})
    return F.unhex(F.md5(whole.cast("binary")))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, before, after): rows that were added, removed or changed, by a key that does not repeat in a version.

    Keys and hashes alone are shuffled for the comparison; whole rows only for
    keys whose hashes differ.  A null key is a key.
    """
    columns = [c for c in old.columns if c != key]

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"{name}_key"), row_hash(columns).alias(name))

    a, b = hashed(old, "before"), hashed(new, "after")
    both = a.join(b, F.col("before_key").eqNullSafe(F.col("after_key")), "full").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    found = versions.stored(both.select(F.when(F.col("after").isNull(), F.col("before_key")).otherwise(F.col("after_key")).alias("__key"), change.alias("change")), versions.scratch(old.sparkSession, "diff"))
    whole = F.struct(*old.columns)
    out = found
    for name, df in (("before", old), ("after", new)):
        rows = df.select(F.col(key).alias(f"__{name}"), whole.alias(name)).join(found.select("__key"), F.col(f"__{name}").eqNullSafe(F.col("__key")), "left_semi")
        out = out.join(rows, F.col("__key").eqNullSafe(F.col(f"__{name}")), "left").drop(f"__{name}")
    return out.withColumnRenamed("__key", key)


def apply_diff(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The newer version from the older one and the difference."""
    gone = changes.select(F.col(key).alias("__gone"))
    kept = old.join(gone, F.col(key).eqNullSafe(F.col("__gone")), "left_anti")
    return kept.unionByName(changes.where("change != 'removed'").select("after.*"))


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows of ``a`` that are not in ``b``, as SQL's EXCEPT; rows are compared by their hashes, of which ``b`` sends nothing else."""
    one = a.withColumn("__h", row_hash(a.columns)).dropDuplicates(["__h"])
    return one.join(b.select(row_hash(a.columns).alias("__h")).distinct(), "__h", "left_anti").select(a.columns)


@dataclass
class Pages:
    """A table sorted once in parts; a page reads the parts that it lies in."""

    sorted: DataFrame
    starts: list[tuple[int, int, int]]  # part, rows before it, rows

    @staticmethod
    def of(df: DataFrame, *order) -> Pages:
        """Sort by ``order``, which should be total; the parts' row counts are all that the driver sees."""
        spark = df.sparkSession
        by = [o if not isinstance(o, str) else F.col(o) for o in order]
        ranged = df.withColumn("__row", F.struct(*df.columns)).repartitionByRange(*by).sortWithinPartitions(*by)
        stored = versions.stored(ranged.select("__row", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place")), versions.scratch(spark, "pages"), "__part")
        counts = sorted((r["__part"], r["n"]) for r in stored.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
        starts, before = [], 0
        for part, n in counts:
            starts.append((part, before, n))
            before += n
        return Pages(stored, starts)

    def __len__(self) -> int:
        return sum(n for _, _, n in self.starts)

    def page(self, offset: int, limit: int) -> DataFrame:
        """``limit`` rows from ``offset`` on, with their ``position``; other parts' folders are not read."""
        wanted = [(p, b) for p, b, n in self.starts if b < offset + limit and b + n > offset]
        before = F.create_map(*[F.lit(x) for p, b in wanted for x in (p, b)]) if wanted else F.create_map(F.lit(-1), F.lit(0))
        place = F.row_number().over(Window.partitionBy("__part").orderBy("__place")) - 1
        rows = self.sorted.where(F.col("__part").isin([p for p, _ in wanted])).withColumn("position", (place + before[F.col("__part")]).cast("bigint"))
        return rows.where((F.col("position") >= offset) & (F.col("position") < offset + limit)).select("__row.*", "position")
