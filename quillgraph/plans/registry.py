"""Queries of the knowledge-graph operators and their DuckDB SQL."""

from .queries import QUERIES
from .sql import ORACLE


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
