"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from kinfold.llm import bpe, collocations, context_mixing, cover_tree, decontamination, features, language_id, neighbours, quality, simhash, substring, suffix_array, token_counts

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_suffix_array_dedup": suffix_array.op3_suffix_array_dedup,
    "op4_context_mixing": context_mixing.op4_context_mixing,
    "op5_language_id": language_id.op5_language_id,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_cover_tree_near_dedup": cover_tree.op7_cover_tree_near_dedup,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_difference_cover_dedup": substring.op9_difference_cover_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_nearest_neighbours": neighbours.op11_nearest_neighbours,
    "op12_point_in_time": features.op12_point_in_time,
    "op13_collocations": collocations.op13_collocations,
    # The vectors of the test tables have no neighbours: the same operator where there are some.
    "cover_tree_planted": cover_tree.cover_tree_planted,
}
SQL = {
    "op2_benchmark_decontamination": decontamination.OP2_SQL,
    "op3_suffix_array_dedup": suffix_array.OP3_SQL,
    "op7_cover_tree_near_dedup": cover_tree.OP7_SQL,
    "op9_difference_cover_dedup": substring.OP9_SQL,
    "op12_point_in_time": features.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
    "cover_tree_planted": cover_tree.PLANTED_SQL,
}
