"""All core queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import evaluation, extractions, graphs, relational, reports, scalars, sessions, streams, texts, timestamp_queries, vector_queries

MODULES = (scalars, relational, graphs, texts, vector_queries, evaluation, extractions, streams, sessions, reports, timestamp_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.plans.sql.items()}
