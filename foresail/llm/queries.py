"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, exact_dedup, html_extract, lm_scoring, mixing, near_dedup, packing, quality_rules, token_store, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_token_store": token_store.op6_token_store,
    "op7_packing": packing.op7_packing,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
