"""The queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, conversation_repair, decontaminate, exact_dedup, jaccard_join, langid, line_dedup, quality, spelling, suffix_dedup, token_count, toxicity

_QUERIES = {
    "op1_language_id": (langid.query, langid.SQL),
    "op2_line_dedup": (line_dedup.query, line_dedup.SQL),
    "op3_quality_classifier": (quality.query, quality.SQL),
    "op4_chat_format": (chat_format.query, chat_format.SQL),
    "op5_suffix_dedup": (suffix_dedup.query, suffix_dedup.SQL),
    "op6_byte_bpe": (bpe.query, bpe.SQL),
    "op7_benchmark_decontamination": (decontaminate.query, decontaminate.SQL),
    "op8_jaccard_join": (jaccard_join.query, jaccard_join.SQL),
    "op9_exact_dedup": (exact_dedup.query, exact_dedup.SQL),
    "op10_toxicity": (toxicity.query, toxicity.SQL),
    "op11_spelling_variants": (spelling.query, spelling.SQL),
    "op12_token_counts": (token_count.query, token_count.SQL),
    "op13_conversation_repair": (conversation_repair.query, conversation_repair.SQL),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
