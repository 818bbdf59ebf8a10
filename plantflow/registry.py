"""Queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under `name`, with DuckDB SQL for the same rows."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    """Import the query modules, which register themselves."""
    from plantflow.plans import asset_queries, class_queries, detail_queries, domain_queries, evidence_queries, extra_queries, filter_queries, history_queries, loop_queries, more_queries, path_queries, procedure_queries, role_queries, series_queries, stream_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return queries()["rollup_fixed"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return {name: _in_utc(fn) for name, fn in _QUERIES.items()}


def _in_utc(fn: Query) -> Query:
    """Timestamps without a zone are read as UTC, whatever the session's zone was."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
