"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import decontaminate, drift_clusters, html_extract, lexical, line_dedup, mixing, near_dedup, neighbours, quality, sentence_dedup, suffix_dedup, toxicity, voronoi


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_quality": quality.op2_quality,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_sentence_dedup": sentence_dedup.op6_sentence_dedup,
        "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op10_html_extraction": html_extract.op10_html_extraction,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op11_exact_top_k": voronoi.op11_exact_top_k,
        "op12_drift_clusters": drift_clusters.op12_drift_clusters,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": mixing.OP3_SQL,
        "op6_sentence_dedup": sentence_dedup.OP6_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op11_exact_top_k": voronoi.OP11_SQL,
        "op12_drift_clusters": drift_clusters.OP12_SQL,
        "op13_lexical_search": lexical.OP13_SQL,
    }
