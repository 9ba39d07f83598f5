"""Run history as tables: existence flags, record lookup, cascade delete, cached results.

The studied service kept runs in a relational store and issued one query per dataset
(N+1). Here the history tables are Parquet datasets and every operation is one join over
all keys: existence is a left join against the distinct child keys, deletion an anti
join, lookup a filter the scan prunes on.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exists_flags(parent: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One boolean column per child table: does the parent key have child rows?

    Each child is reduced to its distinct keys (map-side partial aggregation, so a key with
    a third of the child rows sends one row per task) before the left join.
    """
    out = parent
    for flag, (child, ckey) in children.items():
        keys = child.where(F.col(ckey).isNotNull()).groupBy(F.col(ckey).alias(f"__k_{flag}")).agg(
            F.lit(True).alias(flag))
        out = out.join(keys, out[key] == keys[f"__k_{flag}"], "left").drop(f"__k_{flag}") \
                 .withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return out


def with_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Every child record with its parent row (inner equi-join; AQE picks broadcast or
    sort-merge from the runtime sizes)."""
    return child.join(parent, child[child_key] == parent[parent_key], "inner")


def delete_cascade(tables: Mapping[str, tuple[DataFrame, str]], ids: DataFrame, id_col: str) -> dict[str, DataFrame]:
    """Every table without the rows whose key is in ``ids`` (anti joins). The caller
    writes the results as a new version of each table."""
    gone = ids.select(F.col(id_col).alias("__id")).distinct()
    return {name: df.join(gone, df[k] == gone["__id"], "left_anti") for name, (df, k) in tables.items()}


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The record(s) with ``key == value``; the predicate is pushed to the scan."""
    return df.where(F.col(key) == F.lit(value))


def cached_or_generate(keys: DataFrame, stored: DataFrame, key_cols: Sequence[str],
                       generate: Callable[[DataFrame], DataFrame], refresh: bool = False) -> DataFrame:
    """Stored results for keys that have one, freshly generated ones for the others
    (all keys when ``refresh``); ``source`` tells which."""
    key_cols = list(key_cols)
    if refresh:
        return generate(keys).withColumn("source", F.lit("generated"))
    have = stored.select(*key_cols).distinct()
    missing = keys.join(have, on=key_cols, how="left_anti")
    fresh = generate(missing).withColumn("source", F.lit("generated"))
    old = stored.join(keys.select(*key_cols).distinct(), on=key_cols, how="left_semi").withColumn("source", F.lit("stored"))
    return old.unionByName(fresh)
