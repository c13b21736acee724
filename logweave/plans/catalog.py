"""All queries of the ordered-log engine by name, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.plans import delivery_queries, experiment_queries, frontier_queries, ordering_queries, recovery_queries, slot_queries, source_queries, trace_queries

_ALL = {**ordering_queries.QUERIES, **frontier_queries.QUERIES, **trace_queries.QUERIES, **delivery_queries.QUERIES, **slot_queries.QUERIES, **recovery_queries.QUERIES, **experiment_queries.QUERIES, **source_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
