"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from sievegrid.llm import decontamination, html_text, language, mixing, quality, sharding, simhash, suffixes, toxicity, vectors

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_toxicity": toxicity.query,
    "op4_decontamination": decontamination.query,
    "op5_sharding": sharding.query,
    "op6_mixing": mixing.query,
    "op7_embedding_near_dedup": vectors.query,
    "op8_suffix_dedup": suffixes.query,
    "op9_language_id": language.query,
    "op10_html_extraction": html_text.query,
    "op3_simhash_near_dedup": simhash.query,
}

ORACLE_SQL: dict[str, str] = {
    "op6_mixing": mixing.ORACLE_SQL,
    "op8_suffix_dedup": suffixes.ORACLE_SQL,
}
