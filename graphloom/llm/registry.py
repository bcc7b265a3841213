"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from . import chat_format, decontaminate, jaccard_join, language_id, lm_score, packing, prefix_trie, quality, substring_dedup, suffix_dedup, token_counts, url_filter, whitening

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_language_id": language_id.op7_language_id,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op3_quality_rules": quality.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op6_jaccard_join": jaccard_join.OP6_SQL,
    "op9_suffix_array_dedup": suffix_dedup.OP9_SQL,
    "op11_chat_format": chat_format.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
