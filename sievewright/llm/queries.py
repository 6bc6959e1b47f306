"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from . import archives, fingerprints, language, line_dedup, mixing, ngram_join, packing, quality, sharding, url_lists

QUERIES = {
    "op1_prefix_fingerprint": fingerprints.op1_prefix_fingerprint,
    "op2_vector_sharding": sharding.op2_vector_sharding,
    "op3_retrieval_packing": packing.op3_retrieval_packing,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_language_id": language.op5_language_id,
    "op6_fertility_rules": quality.op6_fertility_rules,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_temporal_url_filter": url_lists.op9_temporal_url_filter,
    "op10_legacy_archives": archives.op10_legacy_archives,
}

SQL = {
    "op7_source_mixing": mixing.OP7_SQL,
    "op9_temporal_url_filter": url_lists.OP9_SQL,
}
