"""Registry of the query catalogue: every plan module adds its queries and oracles here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` together with its DuckDB oracle."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_ORACLES)


def plan(name: str, sql: str | None = None, *views: str):
    """As ``query``, for a function of the ``Tables`` of a folder; the oracle gets the views it reads in front."""
    from ventura.plans.model import Tables, oracle

    def add(fn):
        query(name, oracle(sql, *views) if sql else None)(lambda spark, sf_dir: fn(Tables(spark, sf_dir)))
        return fn

    return add


def load() -> None:
    """Import the plan modules, which register themselves."""
    from ventura.plans import aggregates, imports, joins, merges, reports, reports_data, reports_founders, reports_more, reports_weekly, reports_rest, rules, scalars, sources, statistics, streams, windows  # noqa: F401
