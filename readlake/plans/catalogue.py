"""All queries and their SQL."""

from __future__ import annotations

from . import graph_queries, queries

QUERIES = {**queries.QUERIES, **graph_queries.QUERIES}
SQL = {**queries.SQL, **graph_queries.SQL}
