"""The queries of this subpackage and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from parlance.llm import chat_format, conversation_repair, decontamination, exact_dedup, hard_negatives, line_dedup, lm_scoring, ngram_join, packing, quality, sharding, token_files, url_filter

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_sharding": sharding.op2_sharding,
    "op3_chat_formatting": chat_format.op3_chat_formatting,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_token_files": token_files.op8_token_files,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE_SQL = {
    "op1_decontamination": decontamination.decontamination_sql(),
    "op2_sharding": sharding.OP2_SQL,
    "op3_chat_formatting": chat_format.OP3_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op6_quality_rules": quality.quality_sql(),
    "op10_ngram_jaccard_join": ngram_join.near_duplicates_sql(),
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
