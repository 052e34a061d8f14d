"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from quillmask.llm import audit, avi, divergence, editprint, huffman, language, lines, minhash, mixing, packing, substrings, toxicity, tries

QUERIES = {
    "op1_edit_prints": editprint.op1_edit_prints,
    "op2_pack_sequences": packing.op2_pack_sequences,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_language_id": language.op6_language_id,
    "op7_near_duplicates": minhash.op7_near_duplicates,
    "op8_huffman_tokens": huffman.op8_huffman_tokens,
    "op9_avi_media": avi.op9_avi_media,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_exact_dedup": tries.op12_exact_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE = {
    "op3_substring_dedup": substrings.SQL,
    "op4_mix_sources": mixing.SQL,
    "op5_line_dedup": lines.SQL,
    "op7_near_duplicates": minhash.SQL,
    "op11_filter_audit": audit.SQL,
    "op12_exact_dedup": tries.SQL,
    "op13_source_divergence": divergence.SQL,
}
