"""The registered queries of this folder over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from fretwork.llm import (
    clusters,
    decontamination,
    html_text,
    language,
    lines,
    mixing,
    neighbours,
    quality,
    sharding,
    simhash,
    sketches,
    token_files,
    trie,
)

QUERIES = {
    "op1_language_mixture": language.query,
    "op2_line_dedup": lines.query,
    "op3_ring_shards": sharding.query,
    "op4_token_files": token_files.query,
    "op5_quality_resampling": quality.query,
    "op6_page_text": html_text.query,
    "op7_source_mixture": mixing.query,
    "op8_benchmark_overlap": decontamination.query,
    "op9_nearest_vectors": neighbours.query,
    "op10_simhash_groups": simhash.query,
    "op11_scaled_sketch": sketches.query,
    "op12_pivot_clusters": clusters.query,
    "op13_prefix_trie": trie.query,
}

ORACLE = {
    "op2_line_dedup": lines.SQL,
    "op7_source_mixture": mixing.SQL,
    "op8_benchmark_overlap": decontamination.SQL,
    "op11_scaled_sketch": sketches.SQL,
    "op12_pivot_clusters": clusters.SQL,
    "op13_prefix_trie": trie.SQL,
}
