"""Registered queries of the engine's own operators, with the SQL that an independent database runs for each."""

from __future__ import annotations

from orebody.plans import code_queries, function_queries, graph_queries, index_queries, source_queries, stream_queries, text_queries


def queries() -> dict:
    return text_queries.Q | graph_queries.Q | source_queries.Q | code_queries.Q | function_queries.Q | index_queries.Q | stream_queries.Q


def oracle_sql() -> dict[str, str]:
    return text_queries.SQL | graph_queries.SQL | source_queries.SQL | code_queries.SQL | function_queries.SQL | index_queries.SQL | stream_queries.SQL
