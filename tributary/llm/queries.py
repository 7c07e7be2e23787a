"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import ball_tree, decontaminate, html_text, language, mixing, near_dedup, quality, substring_dedup, suffix_dedup, token_alignment, toxicity, url_filter, warc

QUERIES = {
    "op1_html_extraction": html_text.op1_html_extraction,
    "op2_mixing": mixing.op2_mixing,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_revisits": warc.op5_revisits,
    "op6_language": language.op6_language,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_ball_tree_clusters": ball_tree.op11_ball_tree_clusters,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

#: Where SQL cannot express a query, tests hold it against a brute-force version.
ORACLE = {
    "op3_decontamination": decontaminate.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_revisits": warc.OP5_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_ball_tree_clusters": ball_tree.OP11_SQL,
}
