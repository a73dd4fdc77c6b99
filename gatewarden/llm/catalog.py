"""The registered queries of the subpackage and their DuckDB checks."""

from __future__ import annotations

from gatewarden.llm import (
    bpe, chat, exact_dedup, mixing, near_dedup, neighbours, repair, suffix_dedup, token_counts, token_store, toxicity, warc, whitening)

_MODULES = (bpe, chat, exact_dedup, mixing, near_dedup, neighbours, repair, suffix_dedup, token_counts, token_store,
            toxicity, warc, whitening)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
