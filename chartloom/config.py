"""Constants of the engine, in one frozen object; every "now" is an explicit argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Thresholds and budgets that results depend on."""

    rrf_k: int = 60
    top_k: int = 10
    multi_pass_top_k: int = 8
    passes: int = 3
    max_chunks: int = 8
    multi_pass_max_chunks: int = 12
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    idf_floor: float = 1e-6
    field_weights: tuple = (("content", 2.0), ("section_title", 1.5), ("patient_name", 1.0), ("clinical_category", 1.0))
    keyword_decay: float = 0.5
    keyword_step: float = 0.05
    keyword_cap: float = 0.20
    structure_step: float = 0.03
    structure_cap: float = 0.15
    structure_min_points: int = 3
    overlap_weight: float = 0.1
    plan_boost: float = 0.04
    dedup_jaccard: float = 0.75
    dedup_min_words: int = 5
    mmr_lambda: float = 0.7
    window_tokens: int = 4096
    large_prompt_tokens: int = 4000
    system_tokens: int = 400
    query_tokens: int = 100
    output_tokens: int = 800
    glossary_words: int = 0
    budget_overhead: int = 20
    min_truncated_tokens: int = 50
    min_truncated_words: int = 10
    chars_per_token: float = 1.4
    panel_reserve: int = 300
    panel_safety: float = 0.88

    @property
    def context_tokens(self) -> int:
        return self.window_tokens - self.system_tokens - self.query_tokens - self.output_tokens


SETTINGS = Settings()
