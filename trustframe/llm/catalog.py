"""Registered queries of this package, one for each operator and the pipeline, and SQL where it can express them."""

from __future__ import annotations

from trustframe.llm import (
    bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    language_id,
    lexical_search,
    line_dedup,
    merkle_manifest,
    simhash_dedup,
    substring_dedup,
    token_counts,
    topk_search,
    toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.toxicity_query,
    "op2_chat_format": chat_format.chat_query,
    "op3_topk_search": topk_search.topk_query,
    "op4_language_id": language_id.language_query,
    "op5_substring_dedup": substring_dedup.substring_query,
    "op6_line_dedup": line_dedup.line_query,
    "op7_simhash_dedup": simhash_dedup.simhash_query,
    "op8_decontaminate": decontaminate.decontaminate_query,
    "op9_token_counts": token_counts.token_query,
    "op10_bpe": bpe.bpe_query,
    "op11_merkle_manifest": merkle_manifest.manifest_query,
    "op12_exact_dedup": exact_dedup.exact_query,
    "op13_lexical_search": lexical_search.search_query,
}
ORACLES = {
    "op2_chat_format": chat_format.CHAT_SQL,
    "op3_topk_search": topk_search.TOPK_SQL,
    "op11_merkle_manifest": merkle_manifest.MANIFEST_SQL,
    "op12_exact_dedup": exact_dedup.EXACT_SQL,
    "op13_lexical_search": lexical_search.SEARCH_SQL,
}
