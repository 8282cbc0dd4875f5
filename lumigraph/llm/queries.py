"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage.
MODULES = {
    "op1_embedding_near_dup": "embeddings", "op2_suffix_dedup": "suffix", "op3_mix_sources": "mixing", "op4_warc_revisits": "warc", "op5_decontaminate": "decontaminate",
    "op6_language_id": "language", "op7_quality": "quality", "op8_token_file": "tokenfile", "op9_shard": "sharding", "op10_ngram_jaccard": "jaccard",
}


def queries() -> dict:
    return {name: importlib.import_module(f".{module}", __package__).query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: importlib.import_module(f".{module}", __package__) for name, module in MODULES.items()}
    return {name: m.oracle() for name, m in found.items() if hasattr(m, "oracle")}
