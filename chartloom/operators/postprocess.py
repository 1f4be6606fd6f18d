"""From ranked hits to a context: rerank, dedup, diversify, budget, reorder, assemble.

Order-dependent loops run per query over its few candidates in Python; the
rest is window functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.config import SETTINGS
from chartloom.functions.text import blank_words, space_words, token_count, truncate_at_sentence
from chartloom.operators.formatters import DATE

EMPTY_CONTEXT = "No relevant clinical data found."
PLAN_CATEGORY = "assessmentAndPlan"


def _rank(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def rerank(hits: DataFrame, queries: DataFrame, as_of: str, scores: DataFrame | None = None) -> DataFrame:
    """Word overlap, recency and section boosts (RET-07), or given scores in place of all (RET-07b)."""
    if scores is not None:
        return _rank(hits.drop("score").join(scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"]))
    s = SETTINGS
    asked = queries.select("query_id", F.array_distinct(space_words(F.lower("text"))).alias("__q"))
    overlap = F.size(F.array_intersect("__q", F.array_distinct(space_words(F.lower("content"))))) / F.greatest(F.size("__q"), F.lit(1))
    score = F.col("score") + overlap * s.overlap_weight
    if "date_recorded" in hits.columns:
        days = F.abs(F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("date_recorded").cast("timestamp"))) / F.lit(86400.0)
        score = score + F.coalesce(F.when(days < 30, 0.05).when(days < 90, 0.03).when(days < 365, 0.01), F.lit(0.0))
    if "clinical_category" in hits.columns:
        score = score + F.when(F.col("clinical_category") == PLAN_CATEGORY, s.plan_boost).otherwise(0.0)
    return _rank(hits.join(asked, "query_id").withColumn("score", score).drop("__q"))


def keep_distinct(word_sets: list[set], threshold: float = SETTINGS.dedup_jaccard, least: int = SETTINGS.dedup_min_words) -> list[bool]:
    """Whether each set stays: large enough sets go when they resemble a kept one."""
    kept: list[set] = []
    out = []
    for words in word_sets:
        same = len(words) >= least and any(len(words & k) / len(words | k) >= threshold for k in kept if words | k)
        out.append(not same)
        if not same:
            kept.append(words)
    return out


def deduplicate(hits: DataFrame) -> DataFrame:
    """Greedy near-duplicate removal in rank order (RET-08)."""
    import re

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        sets = [{w for w in re.split(r"[\W_]+", str(c).lower()) if len(w) >= 3} for c in pdf["content"]]
        return pdf[keep_distinct(sets)]

    return hits.groupBy("query_id").applyInPandas(one, hits.schema)


def mmr_order(scores: np.ndarray, vectors: list, limit: int, weight: float = SETTINGS.mmr_lambda) -> list[int]:
    """Maximal marginal relevance: positions chosen, in order; the first best wins ties."""
    left, chosen = list(range(len(scores))), []
    while left and len(chosen) < limit:
        best, best_score = 0, -np.inf
        for at, i in enumerate(left):
            similar = 0.0
            if vectors[i] is not None:
                for j in chosen:
                    if vectors[j] is not None:
                        n = min(len(vectors[i]), len(vectors[j]))
                        similar = max(similar, float(np.dot(vectors[i][:n], vectors[j][:n])))
            value = weight * scores[i] - (1 - weight) * similar
            if value > best_score:
                best, best_score = at, value
        chosen.append(left.pop(best))
    return chosen


def diversify(hits: DataFrame, limit: int = SETTINGS.max_chunks) -> DataFrame:
    """MMR selection where a query has more candidates than the limit (RET-09).

    ``hits`` has ``embedding``, null where there is none; ``rank`` becomes the order of selection.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        if len(pdf) > limit:
            vectors = [None if v is None else np.asarray(v, np.float64) for v in pdf["embedding"]]
            pdf = pdf.iloc[mmr_order(pdf["score"].to_numpy(float), vectors, limit)]
        return pdf.assign(rank=np.arange(1, len(pdf) + 1, dtype=np.int32))

    return hits.groupBy("query_id").applyInPandas(one, hits.schema)


def fit_budget(hits: DataFrame, prefix: str = "contextual_prefix") -> DataFrame:
    """Chunks up to the first that overflows the context, which is truncated if enough room is left (RET-10, WIN-02)."""
    s = SETTINGS
    whole = F.concat(F.coalesce(F.col(prefix), F.lit("")), F.lit(" "), F.col("content")) if prefix in hits.columns else F.concat(F.lit(" "), F.col("content"))
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    start = s.glossary_words + s.budget_overhead
    budget = s.context_tokens
    df = hits.withColumn("__tokens", token_count(whole)).withColumn("__used", F.sum("__tokens").over(by_rank.rowsBetween(Window.unboundedPreceding, 0)) + start)
    df = df.withColumn("__over", F.sum(F.when(F.col("__used") > budget, 1).otherwise(0)).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)))
    left = budget - (F.col("__used") - F.col("__tokens"))
    per_word = F.col("__tokens").cast("double") / F.greatest(F.lit(1), F.size(blank_words(F.col("content"))))
    allowed = F.floor(left / F.greatest(F.lit(0.8), per_word)).cast("int")
    truncated = (F.col("__over") == 1) & (left >= s.min_truncated_tokens) & (allowed > s.min_truncated_words)
    df = df.withColumn("__allowed", allowed).withColumn("__cut", truncated).where((F.col("__over") == 0) | F.col("__cut"))
    content = F.when(F.col("__cut"), truncate_at_sentence(F.col("content"), F.col("__allowed"))).otherwise(F.col("content"))
    return df.withColumn("content", content).drop("__tokens", "__used", "__over", "__allowed", "__cut")


def lost_in_middle(hits: DataFrame) -> DataFrame:
    """Adds ``position``: even ranks forward, then odd ranks backward, best at both ends (RET-12, WIN-03)."""
    i = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    df = hits.withColumn("__i", i).withColumn("__n", n)
    spread = F.when(F.col("__i") % 2 == 0, (F.col("__i") / 2).cast("int")).otherwise((F.col("__n") - 1 - (F.col("__i") - 1) / 2).cast("int"))
    return df.withColumn("position", F.when(F.col("__n") > 2, spread).otherwise(F.col("__i"))).drop("__i", "__n")


def assemble(hits: DataFrame, queries: DataFrame, glossary: str = "") -> DataFrame:
    """(query_id, context): numbered source blocks in position order, or a fixed message (RET-13)."""
    has = hits.columns
    day = F.date_format("date_recorded", DATE) if "date_recorded" in has else F.lit("")
    section = F.col("section_title") if "section_title" in has else F.lit("")
    prefix = F.when(F.col("contextual_prefix") != "", F.col("contextual_prefix")) if "contextual_prefix" in has else F.lit(None).cast("string")
    head = F.concat(F.lit("--- Source "), (F.col("position") + 1).cast("string"), F.lit(" ["), F.coalesce(section, F.lit("")), F.lit("] "), F.coalesce(day, F.lit("")), F.lit(" ---"))
    block = F.concat_ws("\n", head, prefix, F.col("content"), F.lit(""))
    blocks = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("b"))
    text = F.concat(F.lit(glossary + "\n\n" if glossary else ""), F.array_join(F.transform("b", lambda x: x["b"]), "\n"))
    return queries.select("query_id").join(blocks.select("query_id", text.alias("context")), "query_id", "left").withColumn("context", F.coalesce("context", F.lit(EMPTY_CONTEXT)))


def process(hits: DataFrame, queries: DataFrame, as_of: str, max_chunks: int = SETTINGS.max_chunks, scores: DataFrame | None = None) -> DataFrame:
    """The steps in order, up to ``position`` (RET-14)."""
    ranked = rerank(hits, queries, as_of, scores)
    return lost_in_middle(fit_budget(diversify(deduplicate(ranked), max_chunks)))
