"""The registered queries: for every key a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where SQL can say the same, an independent DuckDB query over the raw test tables.

The Spark side calls the library operators; the SQL side re-states each rule in plain
SQL, so a difference between the two shows a bug on one side.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if key in QUERIES:
        raise KeyError(f"duplicate query key {key}")
    QUERIES[key] = fn
    if sql is not None:
        ORACLE[key] = sql


def load_all() -> None:
    from tillroll.catalog import q_clean, q_kpi, q_more, q_sources  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if not QUERIES:
        load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    if not QUERIES:
        load_all()
    return dict(ORACLE)
