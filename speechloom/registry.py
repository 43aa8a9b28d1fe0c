"""All registered queries of the engine and their SQL: ``@query(sql)`` adds a function under its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from .plans import corpus_queries, disfluency_queries, metric_queries, plan_queries, record_queries, score_queries, span_queries, template_queries, value_queries  # noqa: E402, F401
