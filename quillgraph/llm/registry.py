"""Queries opN_<name> of this subpackage and their DuckDB SQL, gathered from the modules."""

from __future__ import annotations

from . import queries_chat, queries_dedup, queries_langid, queries_mixing, queries_near, queries_pii, queries_quality, queries_tokens, queries_topk, queries_url

MODULES = [queries_tokens, queries_langid, queries_quality, queries_dedup, queries_topk, queries_mixing, queries_chat, queries_url, queries_pii, queries_near]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
