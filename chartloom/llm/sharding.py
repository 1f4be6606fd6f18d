"""Proportional stratified interleaving into shards.

Rows of each stratum are shuffled by a seeded hash and ranked; a row's
fractional rank is (rank - 1/2) / size of its stratum.  In the order of
fractional ranks every stretch holds the strata in proportion, so cutting that
order into equal parts gives shards that all match the mixture.

Both ranks come from counts: rows fall into many small buckets of the hash
(then of the fractional rank), buckets are counted, and a row's rank is the
count of the buckets before plus its place in its own.  No stratum, however
large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm import store

N_SHARDS = 40
SEED = 17
BUCKET_ROWS = 20_000
KEY_BITS = 60


def _buckets(spark: SparkSession, rows: int) -> int:
    least = max(rows // BUCKET_ROWS, 4 * store.width(spark), 1)
    return 1 << (least - 1).bit_length()


def shuffle_key(key, seed: int):
    """The first KEY_BITS bits of the MD5 of ``seed:key``: an order that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def assign(rows: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, stratum: str = "source", key: str = "doc_id") -> DataFrame:
    """Adds ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0) to ``rows``.

    Shards differ by at most one row.  Rows with a null stratum form a stratum;
    rows with equal keys stay apart but in an unspecified order between exact
    repeats; an empty table gives an empty result; columns named as the two
    results are replaced.  The input is written once to the shared folder: pass
    only the columns that are needed.
    """
    spark = rows.sparkSession
    keep = store.others(rows, "shard", "slot")
    table = store.materialize(
        rows.select(F.struct(*keep).alias("__row"), F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("__s"), shuffle_key(F.col(key), seed).alias("__h")), "to-shard"
    )
    total = table.count()
    n = _buckets(spark, total)
    bits = n.bit_length() - 1
    table = table.withColumn("__b", F.shiftright("__h", KEY_BITS - bits).cast("int"))
    sizes = table.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__n"))
    by_stratum = Window.partitionBy("__s")
    before = sizes.select("__s", "__b", (F.sum("__n").over(by_stratum.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(by_stratum).alias("__of"))
    place = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", F.xxhash64("__row")))
    ranked = table.withColumn("__place", place).join(before, ["__s", "__b"])
    fraction = (F.col("__before") + F.col("__place") - F.lit(0.5)) / F.col("__of")
    ranked = store.materialize(ranked.select("__row", "__h", fraction.alias("__f"), F.least(F.floor(fraction * n), F.lit(n - 1)).cast("int").alias("__c")), "ranked")

    counts = ranked.groupBy("__c").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__c", (F.sum("__n").over(Window.orderBy("__c")) - F.col("__n")).alias("__start"))  # one row a bucket
    place = F.row_number().over(Window.partitionBy("__c").orderBy("__f", "__h", F.xxhash64("__row")))
    ordered = ranked.withColumn("__place", place).join(starts, "__c").withColumn("__pos", F.col("__start") + F.col("__place") - 1)
    shard = F.expr(f"__pos * {n_shards}L div {max(total, 1)}L")
    first = F.expr(f"(__shard * {max(total, 1)}L + {n_shards - 1}) div {n_shards}")
    return ordered.withColumn("__shard", shard).select(*[F.col("__row")[c].alias(c) for c in keep], F.col("__shard").cast("int").alias("shard"), (F.col("__pos") - first).alias("slot"))


def write_shards(docs: DataFrame, folder: str, n_shards: int = N_SHARDS, seed: int = SEED, stratum: str = "source", key: str = "doc_id", file_rows: int = 100_000) -> None:
    """Write whole documents, a folder a shard, in files of up to ``file_rows`` consecutive slots (column ``part``), each in slot order."""
    placed = assign(docs, n_shards, seed, stratum, key).withColumn("part", F.floor(F.col("slot") / file_rows).cast("int"))
    placed.repartition("shard", "part").sortWithinPartitions("shard", "part", "slot").write.partitionBy("shard", "part").parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = store.text_of()
    docs = store.documents(spark, sf_dir).select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same ranks by plain windows; CRC-32 byte by byte with the table of its polynomial.
ORACLE_SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), hashed AS (
  SELECT doc_id, source, encode(coalesce(text, '')) AS raw, substr(md5('{SEED}:' || doc_id), 1, {KEY_BITS // 4}) AS h FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS place, count(*) OVER (PARTITION BY source) AS n FROM hashed
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY (place - 0.5::DOUBLE) / n::DOUBLE, h) - 1 AS pos, count(*) OVER () AS total FROM ranked
), cut AS (
  SELECT *, CAST(pos * {N_SHARDS} // total AS INTEGER) AS shard FROM ordered
)
SELECT doc_id, CAST(octet_length(raw) + 16 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(raw), '..'), lambda b: CAST('0x' || b AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::BIGINT) AS text_crc32,
  'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut, crc
"""
