"""Distribution and profile operators (EDA): column profile, describe, trimming, histogram,
box statistics, frequency classes."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import ratio
from tillroll.operators.kpi import customer_spend
from tillroll.plans.groups import attach
from tillroll.plans.quantiles import percentiles
from tillroll.schema import EXTREME_QUANTILE, HISTOGRAM_BINS


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column its type and, for text columns, the distinct non-null count.

    All distinct counts come from one aggregate (Catalyst expands it once); ``approx`` uses
    HyperLogLog++ sketches instead.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cd = F.approx_count_distinct if approx else F.count_distinct
    wide = df.agg(*[cd(F.col(c)).alias(c) for c in text]) if text else None
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string")
    if wide is None:
        return types.withColumn("n_unique", F.lit(None).cast("bigint"))
    stack = "stack({}, {}) as (column, n_unique)".format(len(text), ", ".join(f"'{c}', `{c}`" for c in text))
    counts = wide.selectExpr(stack)
    out = F.broadcast(types).join(counts, on="column", how="left")
    return out.select(F.col("position").cast("bigint").alias("position"), "column", "dtype",
                      F.col("n_unique").cast("bigint").alias("n_unique"))


def profile_unique(df: DataFrame, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Distinct customers, products, invoices and countries."""
    cd = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*by).agg(cd("CustomerID").cast("bigint").alias("customers"),
                               cd("StockCode").cast("bigint").alias("products"),
                               cd("InvoiceNo").cast("bigint").alias("invoices"),
                               cd("Country").cast("bigint").alias("countries"))


def describe_numeric(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """D3: count, mean, sample std, min, exact quartiles, max for each column, as rows.

    The plain statistics of all columns come from one aggregate; for the quartiles the
    columns are unpivoted into (column, value) rows and ranked in one percentile
    computation grouped by column. ``DataFrame.summary`` is avoided: its quartiles are
    approximate.
    """
    by = list(by)
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast(T.DoubleType())
        aggs += [F.count(c).cast("bigint").alias(f"n{i}"),
                 (F.sum(F.col(c)).cast(T.DoubleType()) / F.count(c)).alias(f"m{i}"),
                 F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    stack = "stack({}, {}) as (column, count, _mean, _std, _min, _max)".format(
        len(columns), ", ".join(f"'{c}', n{i}, m{i}, s{i}, lo{i}, hi{i}" for i, c in enumerate(columns)))
    base = wide.selectExpr(*by, stack)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(T.DoubleType()).alias("_v"))
                                for c in columns]))
    long = df.select(*by, cells.alias("_e")).select(*by, F.col("_e.column").alias("column"), F.col("_e._v").alias("_v"))
    q = percentiles(long, "_v", [0.25, 0.5, 0.75], [*by, "column"])
    j = base.join(q, on=[*by, "column"], how="left")
    return j.select(*by, "column", "count", ratio("_mean").alias("mean"), ratio("_std").alias("std"),
                    ratio("_min").alias("min"), ratio("p25").alias("p25"), ratio("p50").alias("p50"),
                    ratio("p75").alias("p75"), ratio("_max").alias("max"))


def trim_p99(df: DataFrame, column: str, by: Sequence[str] = (), lower: float | None = 1,
             upper_inclusive: bool = True, q: float = EXTREME_QUANTILE) -> DataFrame:
    """Rows with lower <= x <= q99 (closed), or x < q99 when ``upper_inclusive`` is off
    (customer spend) and ``lower`` is None; q99 is taken per group, before trimming."""
    t = percentiles(df, column, [q], by, names=["_q"])
    x = attach(df, t, by)
    v = F.col(column).cast(T.DoubleType())
    cond = v <= F.col("_q") if upper_inclusive else v < F.col("_q")
    if lower is not None:
        cond = cond & (v >= lower)
    return x.where(cond).withColumnRenamed("_q", "q99")


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, by: Sequence[str] = ()) -> DataFrame:
    """``bins`` equal-width bins between min and max, the last bin closed; all bins are
    returned, empty ones with 0. A constant column uses [v - 0.5, v + 0.5] like NumPy.

    bin = least(floor((x - lo) * bins / (hi - lo)), bins - 1). The bin dimension is bounded
    by ``bins`` and joined on the bin number.
    """
    v = F.col(column).cast(T.DoubleType())
    d = df.where(v.isNotNull()).select(*by, v.alias("_x"))
    rng = d.groupBy(*by).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    rng = rng.select(*by, F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    x = attach(d, rng, by)
    b = F.least(F.floor((F.col("_x") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    counts = x.groupBy(*by, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    dim = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    frame = rng.crossJoin(F.broadcast(dim))
    out = frame.join(counts, on=[*by, "bin"], how="left")
    width = (F.col("_hi") - F.col("_lo")) / bins
    return out.select(*by, F.lit(column).alias("column"), F.col("bin").cast("bigint").alias("bin"),
                      ratio(F.col("_lo") + width * F.col("bin")).alias("lower"),
                      ratio(F.col("_lo") + width * (F.col("bin") + 1)).alias("upper"),
                      F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("count"))


def box_stats(df: DataFrame, column: str, low: float | None = None, high: float | None = None,
              high_inclusive: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5 x IQR whiskers (furthest data inside the fences), outlier count,
    over the rows of the fixed range [low, high] (``high`` open when not inclusive)."""
    v = F.col(column).cast(T.DoubleType())
    cond = F.lit(True)
    if low is not None:
        cond = cond & (v >= low)
    if high is not None:
        cond = cond & ((v <= high) if high_inclusive else (v < high))
    d = df.where(cond & v.isNotNull()).select(*by, v.alias("_x"))
    q = percentiles(d, "_x", [0.25, 0.5, 0.75], by)
    x = attach(d, q, by)
    iqr = F.col("p75") - F.col("p25")
    lo_f, hi_f = F.col("p25") - 1.5 * iqr, F.col("p75") + 1.5 * iqr
    a = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                           F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("wl"),
                           F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("wh"),
                           F.count_if((F.col("_x") < lo_f) | (F.col("_x") > hi_f)).alias("out"))
    # Without keys both sides are global aggregates: one row each, also over an empty range.
    j = q.join(a, on=list(by), how="left") if by else q.crossJoin(a)
    return j.select(*by, F.lit(column).alias("column"), F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
                    ratio("p25").alias("q1"), ratio("p50").alias("median"), ratio("p75").alias("q3"),
                    ratio(F.col("p75") - F.col("p25")).alias("iqr"), ratio("wl").alias("whisker_low"),
                    ratio("wh").alias("whisker_high"), F.coalesce(F.col("out"), F.lit(0)).cast("bigint").alias("outliers"))


def freq_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of customers per number of distinct invoices."""
    c = customer_spend(df, by)
    return c.groupBy(*by, "transaction_count").agg(F.count(F.lit(1)).cast("bigint").alias("customers"))
