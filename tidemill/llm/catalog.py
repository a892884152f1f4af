"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from tidemill.llm import best_fit_packing, bm25_search, chat_format, exact_dedup, piece_sampling, secret_scan, simhash_dedup, token_counts, toxicity, url_filter

_MODULES = [token_counts, piece_sampling, chat_format, url_filter, toxicity, simhash_dedup, secret_scan, best_fit_packing, bm25_search, exact_dedup]

QUERIES = {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
