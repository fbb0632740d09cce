"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, html_extract, jaccard_join, line_dedup, packing, quality_model, quality_rules, substring_dedup, suffix_dedup, token_store

QUERIES = {
    "op1_quality_classifier": quality_model.op1_quality_classifier,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_token_store": token_store.op4_token_store,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
SQL = {"op2_decontamination": decontaminate.ORACLE, "op7_jaccard_join": jaccard_join.ORACLE, "op9_substring_dedup": substring_dedup.ORACLE}
