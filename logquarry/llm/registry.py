"""The queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from logquarry.llm import bloom_lm, decontaminate, exact_dedup, language_id, line_dedup, near_dedup, packing, pii, quality, warc

QUERIES = {
    "op1_best_fit": packing.op1_best_fit,
    "op2_cross_parsing": language_id.op2_cross_parsing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_warc_shards": warc.op4_warc_shards,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_pii_anchors": pii.op6_pii_anchors,
    "op7_minhash_hamming": near_dedup.op7_minhash_hamming,
    "op8_factorisation_machine": quality.op8_factorisation_machine,
    "op10_bloom_lm": bloom_lm.op10_bloom_lm,
    "op9_grace_dedup": exact_dedup.op9_grace_dedup,
    # what SQL can say of operators whose full rows it can't
    "packed_doc_tokens": packing.packed_doc_tokens,
    "language_known": language_id.language_known,
    "pii_base_counts": pii.pii_base_counts,
    "lm_base_scores": bloom_lm.lm_base_scores,
}
SQL = {
    "op3_line_dedup": line_dedup.SQL,
    "op4_warc_shards": warc.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op7_minhash_hamming": near_dedup.SQL,
    "op9_grace_dedup": exact_dedup.SQL,
    "packed_doc_tokens": packing.SQL,
    "language_known": language_id.SQL,
    "pii_base_counts": pii.SQL,
    "lm_base_scores": bloom_lm.SQL,
}
