"""The contract queries op1 to op13 and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat, filter_audit, fingerprints, mixing, ngram_join, periodic_runs, pii, quality, substring_dedup, token_counts, token_files, topk

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_pii": pii.op2_pii,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_token_files": token_files.op10_token_files,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_topk": topk.op13_topk,
}
ORACLES = {
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op6_chat_formatting": chat.OP6_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_periodic_runs": periodic_runs.OP12_SQL,
    "op13_topk": topk.OP13_SQL,
}
