"""Corpus pipeline over ``documents``.

Every stage takes what the one before kept, written as Parquet and read again,
and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import decontaminate, language, near_duplicates, packing, pii, store

#: A document is rejected when no language is likelier than all others together.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is determined.

    Null texts and texts without a letter go; equal rows fare alike; an empty
    table stays empty; other columns, whatever their names, are returned as
    they are.
    """
    found = language.predict(docs.select(F.struct("*").alias("__doc"), F.col("text").alias("__text")), language.model_of(docs), "__text", keep=["__doc"])
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select("__doc.*")


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every group of near-duplicates, by id.

    Texts without a word form no group and stay, as do rows with a null id;
    rows that repeat an id and text become one.
    """
    return near_duplicates.first_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item; null texts hold none, equal rows fare alike."""
    found = decontaminate.scan(docs.select(F.struct("*").alias("__doc"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["__doc"])
    return found.where(F.size("matches") == 0).select("__doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data and what discloses it; ``n_chars`` follows the text.

    Every row stays; null texts stay null with their ``n_chars``, and equal rows
    stay equal.
    """
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their token ids and places in sequences.

    A null text is its end id alone; repeated rows are packed each by itself; an
    empty table gives no piece.
    """
    return packing.pack(packing.cut(docs.select("doc_id", "text")).withColumn("ids_crc32", F.crc32("ids")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicate_join", near_duplicate_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the models nor the banded alignment; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has stored for itself goes once its result is written, as does the result of the one before."""
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), store.mark()
    for name, stage in STAGES[:-1]:
        docs = store.materialize(stage(spark, docs, sf_dir), name)
        store.release(spark, begun, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
