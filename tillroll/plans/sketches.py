"""Approximate quantiles as mergeable state (opt-in; the exact path is :mod:`tillroll.plans.quantiles`).

A KLL sketch per column and group is a few kilobytes whatever the number of rows. Sketches of uploads are stored with them and
merged later, so the quantiles of any set of uploads cost no pass over their rows. With ``k`` = 400 the rank of a returned
value is within about 0.7 % of the wanted one (``RANK_ERROR`` is the bound that is promised here).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400
RANK_ERROR = 0.02


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """``by..., column, n, sketch`` of the non-null values of each column; groups without values have no row."""
    aggs = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(f"s{i}") for i, c in enumerate(columns)]
    counts = [F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(*by).agg(*aggs, *counts)
    items = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)]
    return wide.select(*by, F.inline(F.array(*items))).where("n > 0")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """Sketches of several groups or uploads as one per ``by`` group and column."""
    return sketches.groupBy(*by, "column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by..., column, n, probability, value``."""
    items = [F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value"))
             for p in probs]
    return sketches.select(*by, "column", "n", F.inline(F.array(*items)))
