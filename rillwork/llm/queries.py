"""The subpackage's registered queries and their DuckDB equivalents, where SQL can express them."""

from __future__ import annotations

from rillwork.llm import decontaminate, filter_audit, html_text, language_id, line_dedup, lm_score, media, near_dedup, packing, passage_dedup, quality, token_counts, whitening

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_passage_dedup": passage_dedup.op3_passage_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_media_columns": media.op5_media_columns,
    "op6_language_id": language_id.op6_language_id,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_whitening": whitening.op11_whitening,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_lm_scoring": lm_score.op13_lm_scoring,
}

ORACLE = {
    "op4_near_dedup": near_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
