"""The registered queries, each with the SQL that checks it where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tillflow.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the given tables; ``sql`` computes the same rows."""
    def add(fn):
        @wraps(fn)
        def run(spark, folder):
            return fn(prepare(spark), folder)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def load() -> None:
    """Import every module that registers queries."""
    from tillflow.catalog import (  # noqa: F401
        accounts, batches, checkouts, lives, messages, orders, payments, quality, responses, streams)
