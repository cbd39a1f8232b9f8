"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import byte_gru, chat_format, chat_repair, hidden_markov, jaccard_join, piece_codec, quality_rules, suffix_dedup, template_decontam, voronoi_knn, wavelet_shards, window_dedup

QUERIES = {
    "op3_hidden_markov": hidden_markov.op3_hidden_markov,
    "op1_template_decontam": template_decontam.op1_template_decontam,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op5_byte_gru": byte_gru.op5_byte_gru,
    "op2_chat_format": chat_format.op2_chat_format,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op6_wavelet_shards": wavelet_shards.op6_wavelet_shards,
    "op9_piece_codec": piece_codec.op9_piece_codec,
    "op10_window_dedup": window_dedup.op10_window_dedup,
    "op11_voronoi_knn": voronoi_knn.op11_voronoi_knn,
    "op12_chat_repair": chat_repair.op12_chat_repair,
}

SQL = {
    "op1_template_decontam": template_decontam.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op2_chat_format": chat_format.SQL,
    "op10_window_dedup": window_dedup.SQL,
    "op11_voronoi_knn": voronoi_knn.SQL,
    "op12_chat_repair": chat_repair.SQL,
}
