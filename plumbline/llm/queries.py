"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from plumbline.llm import byte_bpe, fingerprints, html_text, lm_score, mixing, near_dups, quality, suffix_dedup, token_count, toxicity

QUERIES = {
    "op1_token_counts": token_count.op1_token_counts,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_lm_scores": lm_score.op3_lm_scores,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_html_text": html_text.op6_html_text,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_near_duplicates": near_dups.op8_near_duplicates,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op7_mix_sources": mixing.OP7_SQL,
    "op8_near_duplicates": near_dups.OP8_SQL,
}
