"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import chat_views, chosen_path, cube_mixing, hmm_lm, merge_replay, mil_quality, packing, pq_dedup, prefix_trie, quality_rules, separator_scan, shared_lists, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_quality_classifier": mil_quality.query,
    "op3_chat_formatting": chat_views.query,
    "op4_warc": warc.query,
    "op5_byte_bpe": merge_replay.query,
    "op6_quality_rules": quality_rules.query,
    "op7_token_counts": separator_scan.query,
    "op8_embedding_dedup": pq_dedup.query,
    "op9_lm_scoring": hmm_lm.query,
    "op10_minhash_dedup": chosen_path.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_cube_mixing": cube_mixing.query,
    "op13_hard_negatives": shared_lists.query,
}
ORACLES = {"op3_chat_formatting": chat_views.ORACLE, "op4_warc": warc.ORACLE, "op6_quality_rules": quality_rules.ORACLE, "op8_embedding_dedup": pq_dedup.ORACLE, "op10_minhash_dedup": chosen_path.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op13_hard_negatives": shared_lists.ORACLE}
