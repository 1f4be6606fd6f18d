"""Fusion of ranked lists and the boosts that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.config import SETTINGS
from chartloom.functions.text import any_contains, as_re2, keywords

#: How a query for values starts, and what it mentions; what a passage with values looks like.
SPEC_STARTS = ("what is", "what are", "what's", "how much", "how many", "list")
SPEC_WORDS = (
    "dosage", "dose", "level", "levels", "bp", "blood pressure", "temp", "temperature",
    "heart rate", "pulse", "saturation", "lab", "labs", "value", "values", "reading", "readings",
    "mg", "ml", "mmHg", "date", "when", "last", "latest", "history", "trend",
)
SPEC_PATTERNS = (
    r"(?i)\p{Nd}+(?:\.\p{Nd}+)?\s*(?:mg|mcg|ml|mL|g|kg|mEq|mmol|units)\b",
    r"(?i)\p{Nd}+(?:\.\p{Nd}+)?\s*(?:mmHg|bpm|F|C|%)\b",
    r"\p{Nd}{1,3}/\p{Nd}{1,3}\b",
)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, k: int = SETTINGS.top_k, digits: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two (query_id, doc_id, rank) lists; the best 2 k stay (RET-02)."""
    v = vector_hits.select("query_id", "doc_id", F.col("rank").alias("vector_rank"))
    t = text_hits.select("query_id", "doc_id", F.col("rank").alias("keyword_rank"))
    part = lambda c: F.coalesce(1.0 / (SETTINGS.rrf_k + F.col(c)), F.lit(0.0))
    score = part("vector_rank") + part("keyword_rank")
    fused = v.join(t, ["query_id", "doc_id"], "full").withColumn("score", F.round(score, digits) if digits is not None else score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= 2 * k)


def keyword_boost(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds the boost of keywords that few candidates hold (RET-04, AGG-13).

    ``hits`` has query_id, doc_id, content, score.  A keyword's weight falls
    from 1 to 0 as its hit rate among the candidates reaches one half; a match
    at word boundaries counts twice.
    """
    s = SETTINGS
    asked = queries.select("query_id", keywords(F.col("text")).alias("__words"))
    low = F.lower("content")

    def match(w):
        """0, 1 or 2: absent, within a word, between boundaries."""
        spaced = F.concat(F.lit(" "), w)
        bounded = low.contains(F.concat(spaced, F.lit(" "))) | low.contains(F.concat(spaced, F.lit("."))) | low.contains(F.concat(spaced, F.lit(","))) | low.startswith(F.concat(w, F.lit(" "))) | low.endswith(spaced)
        return F.when(low.contains(w), F.when(bounded, 2).otherwise(1)).otherwise(0)

    words = F.coalesce("__words", F.array().cast("array<string>"))
    rows = hits.join(asked, "query_id", "left").withColumn("__match", F.transform(words, match))
    # The candidates of a query meet once, with one number a keyword; the hits are not computed again.
    rows = rows.withColumn("__all", F.collect_list("__match").over(Window.partitionBy("query_id")))
    rate = lambda i: F.aggregate("__all", F.lit(0), lambda n, m: n + F.least(F.get(m, i), F.lit(1))) / F.size("__all")
    points = F.transform("__match", lambda m, i: F.when(m > 0, F.greatest(F.lit(0.0), 1 - rate(i) / s.keyword_decay) * m).otherwise(0.0))
    boost = F.least(F.lit(s.keyword_cap), s.keyword_step * F.aggregate(points, F.lit(0.0), lambda a, b: a + b))
    return rows.withColumn("score", F.col("score") + boost).drop("__words", "__match", "__all")


def is_spec_query(text: Column) -> Column:
    """Whether a query asks for values; compared in lower case, so a mixed-case word never matches (RET-05)."""
    low = F.lower(text)
    starts = F.lit(False)
    for p in SPEC_STARTS:
        starts = starts | low.startswith(p)
    return starts | any_contains(low, SPEC_WORDS)


def structure_points(content: Column) -> Column:
    """3 for a table, 1 for a digit, 2 for each kind of value; patterns are read as DuckDB reads them, since Java takes letters of any script as word characters."""
    pipes = F.length(content) - F.length(F.replace(content, F.lit("|"), F.lit("")))
    points = F.when(pipes >= 3, 3).otherwise(0) + F.when(content.rlike(as_re2(r"\p{Nd}")), 1).otherwise(0)
    for p in SPEC_PATTERNS:
        points = points + F.when(content.rlike(as_re2(p)), 2).otherwise(0)
    return points


def structure_boost(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Raises passages with tables and values for queries that ask for them (RET-06)."""
    s = SETTINGS
    asks = queries.select("query_id", is_spec_query(F.col("text")).alias("__spec"))
    points = structure_points(F.col("content"))
    boost = F.when(F.col("__spec") & (points >= s.structure_min_points), F.least(F.lit(s.structure_cap), points * s.structure_step)).otherwise(0.0)
    return hits.join(asks, "query_id").withColumn("score", F.col("score") + boost).drop("__spec")


def top(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)
