"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from docscreen.llm import (chat, clusters, collocations, language, packing, privacy, quality, sharding, simhash,
                           substrings, urls, vectors, winnowing)

QUERIES = {
    "op1_embedding_codes": vectors.query,
    "op2_quality": quality.query,
    "op3_best_fit_packing": packing.query,
    "op4_hash_ring": sharding.query,
    "op5_simhash": simhash.query,
    "op6_privacy": privacy.query,
    "op7_winnowing": winnowing.query,
    "op8_language": language.query,
    "op9_substring_dedup": substrings.query,
    "op10_chat": chat.query,
    "op11_url_rules": urls.query,
    "op12_vantage_clusters": clusters.query,
    "op13_collocations": collocations.query,
}

ORACLES = {
    "op1_embedding_codes": vectors.ORACLE,
    "op10_chat": chat.ORACLE,
    "op11_url_rules": urls.ORACLE,
    "op12_vantage_clusters": clusters.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
