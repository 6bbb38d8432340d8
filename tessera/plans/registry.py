"""Registry of named queries: a Spark builder and (when SQL can say it) the
DuckDB oracle text.  ``__spark_entry__`` exposes both halves."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_details, q_detect, q_ledger, q_policy, q_redact, q_reports, q_stats, q_stream, q_time  # noqa: F401
