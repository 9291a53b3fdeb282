"""Queries of this subpackage, one per operator, and their oracle SQL."""

from __future__ import annotations

from prefspark.llm import (chat, decontaminate, html_text, lexical, mixing, near_dedup, negatives, quality, secrets, sharding,
                           token_counts, token_files, urls)

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_quality_rules": quality.query,
    "op3_sharding": sharding.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_token_output": token_files.query,
    "op6_token_counts": token_counts.query,
    "op7_secret_scans": secrets.query,
    "op8_mixing": mixing.query,
    "op9_url_filters": urls.query,
    "op10_html_extraction": html_text.query,
    "op11_lexical_search": lexical.query,
    "op12_hard_negatives": negatives.query,
    "op13_chat_formatting": chat.query,
}

ORACLE = {
    "op2_quality_rules": quality.ORACLE,
    "op7_secret_scans": secrets.ORACLE,
    "op9_url_filters": urls.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_chat_formatting": chat.ORACLE,
}
