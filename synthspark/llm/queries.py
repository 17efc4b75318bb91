"""Registered queries of the training-data operators, and reference SQL where SQL can express them."""

from __future__ import annotations

from synthspark.llm import (
    decontaminate,
    flat_graph,
    harmonic,
    kd_shards,
    language_codes,
    licenses,
    line_chunks,
    packing,
    reach_workers,
    simhash,
    spellings,
    token_counts,
    token_links,
    weak_quality,
)


def _registered(query):
    return lambda spark, sf_dir: query(reach_workers(spark), sf_dir)


QUERIES = {
    name: _registered(query)
    for name, query in {
        "op1_token_counts": token_counts.query,
        "op2_simhash_dedup": simhash.query,
        "op3_weak_quality": weak_quality.query,
        "op4_flat_graph": flat_graph.query,
        "op5_benchmark_windows": decontaminate.query,
        "op6_language_codes": language_codes.query,
        "op7_best_fit_packing": packing.query,
        "op8_line_chunks": line_chunks.query,
        "op9_licenses": licenses.query,
        "op10_kd_shards": kd_shards.query,
        "op11_token_links": token_links.query,
        "op12_spelling_variants": spellings.query,
        "op13_harmonic_packing": harmonic.query,
    }.items()
}

SQL: dict[str, str] = {
    "op8_line_chunks": line_chunks.SQL,
}
