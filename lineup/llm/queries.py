"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from lineup.llm import bpe_reuse, chat, collocations, license_scan, near_dup, packing, quality, resampling, substring_dup, token_store, vectors, winnowing

QUERIES = {
    "op1_nearest_neighbours": vectors.query_nearest,
    "op2_exact_topk": vectors.query_products,
    "op3_chosen_path_dedup": near_dup.query,
    "op4_bpe_chunk_reuse": bpe_reuse.query,
    "op5_mixture_packing": packing.query,
    "op6_chunk_store": token_store.query,
    "op7_chat_parts": chat.query,
    "op8_ftrl_quality": quality.query,
    "op9_license_scan": license_scan.query,
    "op10_fm_index_repeats": substring_dup.query,
    "op11_winnowing": winnowing.query,
    "op12_collocations": collocations.query,
    "op13_importance_resampling": resampling.query,
}
SQL = {
    "op1_nearest_neighbours": vectors.SQL_NEAREST,
    "op2_exact_topk": vectors.SQL_PRODUCTS,
    "op7_chat_parts": chat.SQL,
    "op11_winnowing": winnowing.SQL,
    "op12_collocations": collocations.SQL,
    "op13_importance_resampling": resampling.SQL,
}
