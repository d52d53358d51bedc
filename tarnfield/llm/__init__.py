"""Operators of a training-data pipeline, and the queries that apply them to whole tables.

Nothing else in the library imports this subpackage. Its modules are imported when a
query is asked for: a task that runs one operator does not load the others.
"""

from importlib import import_module

#: Module and query of each operator, in order; those whose module has SQL for the query.
_QUERIES = {
    "op1_token_counts": "token_counts", "op2_quality_rules": "quality_rules", "op3_suffix_dedup": "suffix_dedup", "op4_sharding": "sharding", "op5_url_filters": "url_filters", "op6_topk_search": "topk_search", "op7_mixing": "mixing", "op8_license_scans": "license_scans",
    "op9_sentencepiece": "sentencepiece_codec", "op10_simhash_dedup": "simhash_dedup", "op11_prefix_trie": "prefix_trie", "op12_merkle_manifest": "merkle_manifest", "op13_minhash_dedup": "minhash_dedup",
}
_WITH_SQL = ("op3_suffix_dedup", "op4_sharding", "op5_url_filters", "op6_topk_search", "op7_mixing", "op11_prefix_trie", "op12_merkle_manifest", "op13_minhash_dedup")


def _module(query: str):
    return import_module(f"{__name__}.{_QUERIES[query]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the query; the others are tested against brute force."""
    return {name: _module(name).oracle_sql() for name in _WITH_SQL}
