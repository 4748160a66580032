"""Registry of the named queries and their DuckDB oracles.

Each query is a function (spark, sf_dir) -> DataFrame that reads the driver
tables (through the fixture views) and runs the operators of the library.
Computed columns carry the same alias in the Spark plan and in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from threadline.plans import (q_accounts, q_io, q_labels, q_metrics, q_models,  # noqa: F401
                                  q_sampling, q_streaming, q_text, q_tokens)
