"""The queries of the training-data operators, and their DuckDB SQL where there is any."""

from __future__ import annotations

from . import html_text, lloyd, merkle, metric, mixing, near, packing, quality, substrings, suffixes, tools, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_mixing": mixing.op4_mixing,
    "op5_warc": warc.op5_warc,
    "op6_suffix_array_dedup": suffixes.op6_suffix_array_dedup,
    "op7_tool_call_linking": tools.op7_tool_call_linking,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_exact_top_k": metric.op9_exact_top_k,
    "op10_near_dedup": near.op10_near_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_vector_codes": lloyd.op13_vector_codes,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op9_exact_top_k": metric.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_vector_codes": lloyd.OP13_SQL,
}
