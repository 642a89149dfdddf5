"""Query registry: one entry per operator of the inventory.

Every query reads the driver tables at ``sf_dir`` (directly or through the derived views of
``sources.fixtures``) and returns a lazy DataFrame; floats are rounded to 6 decimals so that the
Spark result and its DuckDB twin compare exactly. ``ORACLES`` holds the SQL twin, or nothing for
operators that SQL cannot state (iterative rewrites, diff merges, streams): those are checked in
``tests/`` against a brute-force restatement on small inputs instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    """Import the modules that register queries."""
    from tagloom.plans import q_dataset, q_wiki, q_state, q_misc  # noqa: F401
