"""The registry: every query of the library's own operators, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cluster_queries, fold_queries, incarnation_queries, log_queries, metric_queries, resource_queries, series_queries, source_queries, trace_queries, typed_queries
from .views import with_views

_MODULES = (trace_queries, log_queries, metric_queries, cluster_queries, source_queries, resource_queries, series_queries, fold_queries, incarnation_queries, typed_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for m in _MODULES for name, sql in m.SQL.items()}
