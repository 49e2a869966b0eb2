"""The registry of queries outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusjobs.plans import answer_queries, chunk_queries, graph_queries, ingest_queries, search_queries

MODULES = [ingest_queries, chunk_queries, search_queries, graph_queries, answer_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
