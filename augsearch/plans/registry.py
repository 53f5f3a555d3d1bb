"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query, and its SQL where there is one."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _SQL[name]


def _load() -> None:
    from augsearch.plans import text_queries, vector_queries  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join discovery: every column of the tables as text, as a vector, and the nearest columns of other tables for each."""
    from pyspark.sql import functions as F

    from augsearch.operators import encoders, prompts, retrieval
    from augsearch.plans.text_queries import cells

    embedded = encoders.Pipelines((encoders.HashingEncoder(),), (prompts.DeepJoinStrategy(max_length=500),)).embed(cells(spark, sf_dir))
    columns = embedded.withColumn("table_id", F.substring_index("column_id", "::", 1))
    return retrieval.join_discovery(columns.withColumnRenamed("column_id", "query_id"), columns.withColumnRenamed("column_id", "candidate_id"), 5)
