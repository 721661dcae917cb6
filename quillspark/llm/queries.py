"""The training-data queries and the SQL that DuckDB can check them by."""

from __future__ import annotations

from quillspark.llm import bpe, chat, exact_dedup, merkle, packing, passages, quality, sharding, simhash, suffix_dedup, token_counts, url_filter, whitening


def queries() -> dict:
    return {
        "op1_compact_windows": passages.op1_compact_windows,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_chat_format": chat.op3_chat_format,
        "op4_sharding": sharding.op4_sharding,
        "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_simhash": simhash.op8_simhash,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_bpe": bpe.op10_bpe,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_whitening": whitening.op12_whitening,
        "op13_token_counts": token_counts.op13_token_counts,
    }


def oracle_sql() -> dict:
    return {"op3_chat_format": chat.OP3_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op7_quality_rules": quality.OP7_SQL, "op11_merkle_manifest": merkle.OP11_SQL}
