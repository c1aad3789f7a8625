"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from lectern.llm import adaptive_scan, bit_sliced, branch_merge, chat_format, language_id, merkle, minhash_dedup, packing, quality_rules, sentence_pieces, substring_dedup, toxicity, url_filters

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_exact_top_k": bit_sliced.op4_exact_top_k,
    "op5_language_id": language_id.op5_language_id,
    "op6_sentencepiece": sentence_pieces.op6_sentencepiece,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_adaptive_scan": adaptive_scan.op12_adaptive_scan,
    "op13_branch_merge": branch_merge.op13_branch_merge,
}

ORACLES = {
    "op1_chat_format": chat_format.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_url_filters": url_filters.ORACLE,
    "op4_exact_top_k": bit_sliced.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op10_minhash_dedup": minhash_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_branch_merge": branch_merge.ORACLE,
}
