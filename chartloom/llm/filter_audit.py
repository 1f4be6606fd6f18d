"""How a chain of quality filters interacts, in every order.

Words are exploded and counted by (document, word), then by document for totals
and distinct words; the flags of the other filters are outer-joined.  The
filters that a document fails are a set, one of 32: each part of the corpus is
summed up by 32 conditional counts (of all its documents, of the good and of
the toxic ones), and what any order of the filters keeps, removes or repeats is
a sum of those.

Texts are dealt by document once, so that both word counts are made where the
words are exploded and no row a word is shuffled.  Repeated rows are dealt apart
by the task that read them.  All other steps take a few numbers a document.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import store

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
SETS = range(1 << len(FILTERS))


def word_totals(docs: DataFrame) -> DataFrame:
    """(id, hash, words, distinct) of each (id, text) that has a word; texts of one id are told apart by their hash."""
    key = ["id", "hash", "task"]
    texts = docs.select("id", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("task"), "text").repartition(*key)
    words = texts.select(*key, F.posexplode(F.array_remove(F.split("text", BLANK), "")).alias("place", "word"))
    by_word = words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("place") == 0).alias("copies"))
    by_task = by_word.groupBy(*key).agg((F.sum("n") / F.sum("copies")).cast("bigint").alias("words"), F.count(F.lit(1)).alias("distinct"))
    return by_task.groupBy("id", "hash").agg(F.max("words").alias("words"), F.max("distinct").alias("distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, copies): a row for every different (doc_id, text, part), with the set of filters it fails as bits, A the lowest.

    A null text is empty and fails A; of equal texts all but those of the least
    id fail E, and a null id is no other's equal.  A document without labels is
    neither good nor toxic; of several labels one is enough.
    """
    docs = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), store.text_of().alias("text"))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    flags = docs.select(
        "id", "part", F.xxhash64("text").alias("hash"), F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * upper > MAX_UPPER_PERCENT * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"),
    )
    flags = store.materialize(flags.groupBy("id", "part", "hash", "digest", "c", "d").agg(F.count(F.lit(1)).alias("copies")), "filter-flags")
    words = word_totals(docs)
    first = flags.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").select(F.col("id").alias("first"), F.col("digest").alias("of"))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("doc_id is not null")
    joined = (
        flags.join(words.toDF("w_id", "w_hash", "words", "distinct"), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("hash") == F.col("w_hash")), "left")
        .join(first, (F.col("id") == F.col("first")) & (F.col("digest") == F.col("of")), "left")
        .join(known.toDF("l_id", "good", "toxic"), F.col("id") == F.col("l_id"), "left")
    )
    n, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    fails = {"A": n < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT_PERCENT * n, "C": F.col("c"), "D": F.col("d"), "E": F.col("id").isNotNull() & F.col("first").isNull()}
    failed = sum((F.when(fails[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    return joined.select("part", failed.alias("failed"), (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"), "copies")


def set_counts(failed: DataFrame) -> DataFrame:
    """A row a part; ``all_m``, ``good_m`` and ``toxic_m`` count the documents that fail just the filters of set m."""
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    return failed.groupBy("part").agg(*[F.sum(F.when((F.col("failed") == m) & of, F.col("copies")).otherwise(0)).alias(f"{kind}_{m}") for kind, of in kinds.items() for m in SETS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, by part.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic;
    other columns are ignored.  Every part has all 600 rows, zeros included; a
    null language is the part of the empty string, repeated rows count as often
    as they occur, and an empty table has no part.
    """
    spark = docs.sparkSession
    counts = store.materialize(set_counts(failures(docs, labels)), "filter-sets")
    places = [("".join(o), k + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in o[:k])) for o in itertools.permutations(FILTERS) for k, f in enumerate(o)]
    steps = spark.createDataFrame(places, "filter_order string, step int, own int, before int")  # 600 rows
    sets = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), *[F.col(f"{kind}_{m}").alias(kind) for kind in ("all", "good", "toxic")]) for m in SETS]))
    sets = counts.select("part", sets.alias("s")).select("part", "s.*")
    here, earlier = F.col("m").bitwiseAND(F.col("own")) != 0, F.col("m").bitwiseAND(F.col("before")) != 0

    def total(of, column="all"):
        return F.sum(F.when(of, F.col(column)).otherwise(0))

    rows = sets.crossJoin(F.broadcast(steps)).groupBy("part", "filter_order", "step", "own").agg(
        total(~here & ~earlier).alias("kept"), total(here & ~earlier).alias("removed"), total(here & earlier).alias("redundant"), total(F.col("m") == F.col("own")).alias("unique_fails"),
        total(here & ~earlier, "good").alias("good_lost"), total(here & ~earlier, "toxic").alias("toxic_lost"),
    )
    shapley = rows.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "own"]).drop("own")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(store.documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


ORACLE_SQL = rf"""
WITH letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM orders, range(1, 6) r(step)
), words AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS word FROM documents
), by_word AS (
  SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL
), totals AS (
  SELECT doc_id, sum(n) AS words, count(*) AS distinct_words FROM by_word GROUP BY doc_id
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN coalesce(words, 0) < {MIN_WORDS} THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * coalesce(distinct_words, 0) < {MIN_DISTINCT_PERCENT} * coalesce(words, 0) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_UPPER_PERCENT} * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '{SYMBOLS}') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS failed
  FROM docs LEFT JOIN totals USING (doc_id) LEFT JOIN known USING (doc_id)
), sets AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL
), judged AS (
  SELECT *, contains(failed, own) AS here, before <> '' AND regexp_matches(failed, '[' || before || '-]') AS earlier FROM sets, steps
), result AS (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (here AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (here AND NOT earlier), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (here AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM result
"""
