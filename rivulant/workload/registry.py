"""Name -> query and name -> SQL, filled by the decorator below."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

GROUPS = (
    "findings", "store", "compare", "numeric", "logs", "quality",
    "symbols", "telemetry", "files", "streams", "units",
)


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is the same result for an independent engine."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def _load() -> None:
    for group in GROUPS:
        importlib.import_module(f"rivulant.workload.{group}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
