"""Registered queries of the corpus operators and their DuckDB text."""

from __future__ import annotations

from factorwise.llm import (
    chaining, decontam, exact_dedup, kmeans, langid, mixing, secrets, sharding, simhash, spelling, suffix_dedup, tokens, urlfilter,
)

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_language_id": langid.op3_language_id,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
    "op6_collinear_chaining": chaining.op6_collinear_chaining,
    "op7_benchmark_decontamination": decontam.op7_benchmark_decontamination,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_sharding": sharding.op10_sharding,
    "op11_token_counts": tokens.op11_token_counts,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_centroid_clustering": kmeans.op13_centroid_clustering,
}
SQL = {
    "op4_url_filter": urlfilter.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_centroid_clustering": kmeans.OP13_SQL,
}
