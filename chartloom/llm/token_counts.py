"""Token counts through a digest cache.

A text's key is the digest of its normalised content plus the digest of the
tokenizer file, by which the cache is partitioned.  Normalisation joins texts
that the tokenizer cannot tell apart: null is empty, and the space symbol that
the model writes for a space is a space.  Digests alone are joined with the
stored ones.  If none is missing no text moves; where the cache knows some, a
sketch of the missing digests of fixed size keeps most other texts from being
shuffled.  One document of each missing digest is encoded, and its count is
appended to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import store
from chartloom.llm.tokens import PieceCounter, load, vocabulary_digest, vocabulary_path

#: A sketch has this many bits, in words of 64: as many rows at most as SKETCH_BITS / 64.
SKETCH_BITS = 1 << 22
SCHEMA = "digest binary, n_tokens bigint"


def _version(path: str) -> str:
    return f"tokenizer={vocabulary_digest(path)[:16]}"


def normalised(text_column: str):
    return F.replace(store.text_of(text_column), F.lit("\u2581"), F.lit(" "))


def _sketched(docs: DataFrame, missing: DataFrame) -> DataFrame:
    """The rows whose ``__digest`` may be among the missing ones: all that are, and few others while these are few."""

    def place(digest):
        return F.pmod(F.xxhash64(digest), F.lit(SKETCH_BITS)).cast("bigint")

    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    words = missing.select(place("__key").alias("at")).groupBy(F.floor(F.col("at") / 64).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    words = store.materialize(words, "sketch")  # at most SKETCH_BITS / 64 rows
    at = place("__digest")
    own = F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))
    found = docs.join(F.broadcast(words), F.floor(at / 64) == F.col("__word"))
    return found.where(F.col("__bits").bitwiseAND(own) != 0).select(*docs.columns)


def _encoder(path: str):
    def run(batches) -> Iterator:
        import pyarrow as pa

        counter = load(PieceCounter, path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.counts(b.column(1)), pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame,
    cache: str | None = None,
    tokenizer: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` without its text, plus ``n_bytes`` and ``n_tokens``.

    ``cache`` is a folder that later calls may share; without one the call keeps
    its counts in a new shared folder.  Null and empty texts count 0 tokens;
    equal texts get equal counts; an empty table gives an empty result; repeated
    and null ids and extra columns are kept as they are, but for columns named
    as the two results, which are replaced.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    path = tokenizer or vocabulary_path("piece_bpe_32k.model")
    folder = f"{cache or store.scratch(spark, 'token-cache')}/{_version(path)}"
    text = store.text_of(text_column)
    key = F.unhex(F.sha2(normalised(text_column), 256)).alias("__digest")
    keep = [c for c in store.others(docs, "n_bytes", "n_tokens") if c != text_column]
    keyed = docs.select(F.struct(*keep or [F.lit(0).alias("__none")]).alias("__row"), F.octet_length(text).cast("bigint").alias("__bytes"), key)

    wanted = docs.select(F.col(id_column).alias("__id"), key).groupBy("__digest").agg(F.min("__id").alias("__id"))
    stored = store.exists(spark, folder)
    if stored:
        known = spark.read.schema(SCHEMA).parquet(folder).select(F.col("digest").alias("__digest"))
        wanted = wanted.join(known, "__digest", "left_anti")
    wanted = store.materialize(wanted.toDF("__key", "__rep"), "token-misses")
    if not (stored and wanted.isEmpty()):
        texts = docs.select(F.col(id_column).alias("__id"), key, normalised(text_column).alias("text"))
        texts = _sketched(texts, wanted) if stored else texts
        misses = (
            texts.join(wanted.hint("shuffle_hash"), [F.col("__id").eqNullSafe(F.col("__rep")), F.col("__digest") == F.col("__key")], "left_semi")
            .select("__digest", "text")
            .mapInArrow(_encoder(path), SCHEMA)
        )
        misses.write.mode("append").parquet(folder)

    # Repeated rows, or two runs at once, may have stored a count more than once: one a key.
    counts = spark.read.schema(SCHEMA).parquet(folder)
    if stored:
        counts = counts.join(docs.select(key.alias("digest")).distinct(), "digest", "left_semi")
    counts = store.materialize(counts.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "token-counts")  # joined as a plain table, so that a hot digest's rows can be split
    out = keyed.join(counts, F.col("__digest") == F.col("digest"))
    return out.select(*[F.col("__row")[c].alias(c) for c in keep], F.col("__bytes").alias("n_bytes"), "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(store.documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
