"""The queries of the training-data operators and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from weft.llm import bpe, chat, decontaminate, exact_dedup, language, line_dedup, near_dedup, search, sharding, substring_dedup, token_counts, toxicity, variants

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_byte_bpe": bpe.query,
    "op3_decontaminate": decontaminate.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_near_dedup": near_dedup.query,
    "op6_sharding": sharding.query,
    "op7_chat": chat.query,
    "op8_language": language.query,
    "op9_toxicity": toxicity.query,
    "op10_token_counts": token_counts.query,
    "op11_search": search.query,
    "op12_line_dedup": line_dedup.query,
    "op13_variants": variants.query,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op7_chat": chat.ORACLE_SQL,
    "op11_search": search.ORACLE_SQL,
    "op12_line_dedup": line_dedup.ORACLE_SQL,
}
