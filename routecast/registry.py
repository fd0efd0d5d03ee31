"""The registered queries of the library and the SQL they are checked against.

A query is a function of (spark, sf_dir). Modules of `routecast.plans` register them with `query`; `load` imports all.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLANS = ("projections", "sources", "validation", "trials", "agreement", "scoring", "sampling", "scenarios", "logs", "inference", "streams", "reports")


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def load() -> None:
    for name in PLANS:
        import_module(f"routecast.plans.{name}")
