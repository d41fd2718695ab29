"""Queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import decontaminate, html_text, jaccard_join, language, line_dedup, mixing, substring_dedup, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_decontaminate": decontaminate.query,
    "op3_language": language.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_exact_topk": topk.query,
    "op6_mix_sources": mixing.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_toxicity": toxicity.query,
    "op10_html_text": html_text.query,
}
ORACLE = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_exact_topk": topk.ORACLE,
    "op7_jaccard_join": jaccard_join.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
}
