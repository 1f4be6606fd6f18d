"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from chartloom.llm import decontaminate, filter_audit, fingerprint, language, main_text, near_duplicates, packing, periodic_runs, pii, sharding, token_counts, token_files, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_decontamination": decontaminate.query,
    "op3_sharding": sharding.query,
    "op4_pii": pii.query,
    "op5_ngram_jaccard_join": near_duplicates.query,
    "op6_url_filter": url_filter.query,
    "op7_fingerprint": fingerprint.query,
    "op8_token_counts": token_counts.query,
    "op9_token_files": token_files.query,
    "op10_language_id": language.query,
    "op11_filter_audit": filter_audit.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_html_extraction": main_text.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_sharding": sharding.ORACLE_SQL,
    "op5_ngram_jaccard_join": near_duplicates.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
}
