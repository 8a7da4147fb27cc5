"""The registry of named queries and of their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("scans", "verbs", "joins", "reports", "curves", "orders", "scalars", "streams", "composites")
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where one exists, the SQL that must agree with it."""

    def register(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = fn
        if sql is not None:
            _oracles[name] = sql
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"sluiceflow.plans.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
