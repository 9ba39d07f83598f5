"""Attach per-group (or global) aggregates back to rows without an unbounded broadcast."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Join ``stats`` (one row per ``by`` group) to every row of ``df``.

    Without keys ``stats`` is a single aggregate row: a broadcast cross join of one row is
    bounded by construction. With keys it is an equi-join (null-safe on the keys); AQE
    broadcasts it only if the runtime size is under the broadcast threshold.
    """
    by = list(by)
    if not by:
        return df.crossJoin(F.broadcast(stats))
    s = stats.select(*[F.col(k).alias(f"__g_{k}") for k in by],
                     *[c for c in stats.columns if c not in by])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(s[f"__g_{k}"]) for k in by])
    return df.join(s, cond, "left").drop(*[f"__g_{k}" for k in by])


def keys(by: Sequence[str]) -> list:
    return [F.col(k) for k in by]
