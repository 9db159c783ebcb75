"""Registry of the engine's queries and of the SQL that each is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "bm25_topk"
PLANS = ("relational", "provenance", "retrieval", "memory", "evaluation", "skillbank", "records", "replies", "streams")

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its SQL if it has one."""

    def register(fn: Query) -> Query:
        _queries[name] = fn
        if sql is not None:
            _oracles[name] = sql
        return fn

    return register


def _load() -> None:
    for plan in PLANS:
        importlib.import_module(f"palimpsest.plans.{plan}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
