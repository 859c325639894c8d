"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from colloquy.llm import bpe, centroid_clusters, chat, cotraining, decontaminate, fill_middle, language_id, line_dedup, near_dedup, quality_rules, token_counts, token_files, toxicity

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_language_id": language_id.op2_language_id,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_bpe": bpe.op5_bpe,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_chat": chat.op8_chat,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_cotraining": cotraining.op10_cotraining,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_centroid_clusters": centroid_clusters.op13_centroid_clusters,
}
ORACLES = {
    "op8_chat": chat.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op13_centroid_clusters": centroid_clusters.ORACLE,
}
