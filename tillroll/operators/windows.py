"""Window operators: moving averages, month-over-month growth, Pareto, latest / history.

Windows run on aggregates (daily, monthly) whose size is bounded by the calendar, or use
the distributed running total of :mod:`tillroll.plans.prefix` when the ordered set grows
with the data (products, records of one key).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import dround, money, ratio
from tillroll.operators.kpi import daily_raw, monthly_raw, product_performance_raw
from tillroll.plans.prefix import running_total
from tillroll.schema import PARETO_SHARE


def moving_average(df: DataFrame, by: Sequence[str] = (), windows: Sequence[int] = (7, 30)) -> DataFrame:
    """N-row moving average of daily revenue; 0 until the window is full.

    Rows are the days present (not calendar days), as in the studied code. The window runs
    over the daily aggregate: one row per day and group.
    """
    d = daily_raw(df, by)
    w = Window.partitionBy(*by).orderBy("Date")
    out = d.select(*by, "Date", money("_rev").alias("daily_revenue"), "_rev")
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        full = F.count("_rev").over(frame) == n
        avg = F.sum("_rev").over(frame).cast(T.DoubleType()) / n
        out = out.withColumn(f"revenue_{n}d_ma", ratio(F.when(full, avg).otherwise(F.lit(0.0))))
    return out.drop("_rev")


def monthly_growth(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Month-over-month growth % of the (cent-rounded) monthly revenue, with trend.

    growth = (cur - prev) / prev x 100 rounded to 2 digits when prev > 0; otherwise NULL and
    the trend is 'stable'. The first month has no growth and no trend. ``is_latest`` marks
    the headline month of each group.
    """
    m = monthly_raw(df, by).withColumn("_rev", F.round("_rev", 2))
    w = Window.partitionBy(*by).orderBy("Year", "Month")
    prev = F.lag("_rev").over(w)
    x = m.withColumn("_prev", prev).withColumn("_k", F.row_number().over(w)) \
         .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    growth = F.when(F.col("_prev") > 0, dround((F.col("_rev") - F.col("_prev")).cast(T.DoubleType())
                                               / F.col("_prev").cast(T.DoubleType()) * 100, 2))
    trend = (F.when(F.col("_prev").isNull(), F.lit(None).cast("string"))
             .when(~(F.col("_prev") > 0), F.lit("stable"))
             .when(F.col("_rev") > F.col("_prev"), F.lit("increasing")).otherwise(F.lit("decreasing")))
    return x.select(*by, F.format_string("%d-%02d", "Year", "Month").alias("period"),
                    F.col("_rev").cast(T.DoubleType()).alias("revenue"),
                    F.col("_prev").cast(T.DoubleType()).alias("prev_revenue"),
                    growth.alias("revenue_mom"), trend.alias("revenue_trend"),
                    ((F.col("_k") == F.col("_n")) & (F.col("_n") >= 2)).alias("is_latest"))


def pareto(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Products by descending revenue with rank and cumulative revenue share (%).

    Ties on revenue are ordered by StockCode, then Description. The running sum is exact
    (DECIMAL) and distributed over range slices, never gathered into one task.
    """
    p = product_performance_raw(df, by)
    order = [F.col("_rev").desc(), F.col("StockCode").asc(), F.col("Description").asc()]
    r = running_total(p, order, "_rev", by)
    pct = F.col("_running").cast(T.DoubleType()) / F.col("_group_total").cast(T.DoubleType()) * 100
    return r.select(*by, "StockCode", "Description", F.col("_rank").cast("bigint").alias("rank"),
                    money("_rev").alias("total_revenue"), money("_running").alias("cumulative_revenue"),
                    ratio(pct).alias("cumulative_pct"))


def pareto_top_share(df: DataFrame, by: Sequence[str] = (), share: float = PARETO_SHARE) -> DataFrame:
    """Revenue share of the top floor(share x n) products.

    The k largest revenues sum to the same value whatever the tie order, so a rank from the
    distributed running count suffices.
    """
    p = product_performance_raw(df, by)
    order = [F.col("_rev").desc(), F.col("StockCode").asc(), F.col("Description").asc()]
    r = running_total(p, order, "_rev", by)
    k = F.floor(F.col("_group_rows") * share)
    a = r.groupBy(*by).agg(F.first("_group_rows").alias("_n"), F.first(k).alias("_k"),
                           F.sum(F.when(F.col("_rank") <= k, F.col("_rev"))).alias("_top"),
                           F.first("_group_total").alias("_total"))
    pct = F.coalesce(F.col("_top"), F.lit(0)).cast(T.DoubleType()) / F.col("_total").cast(T.DoubleType()) * 100
    return a.select(*by, F.col("_n").cast("bigint").alias("products"), F.col("_k").cast("bigint").alias("top_count"),
                    money(F.coalesce(F.col("_top"), F.lit(0))).alias("top_revenue"), money("_total").alias("total_revenue"),
                    ratio(pct).alias("concentration_pct"))


def latest_per_key(df: DataFrame, key: str, ts: str, tiebreak: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The newest record of every key (newest ``ts``, then highest ``tiebreak``).

    ``max_by`` is a partial aggregate: each task keeps one candidate per key, so a key that
    holds a third of all records costs no more than any other.
    """
    cols = list(columns or [c for c in df.columns if c != key])
    rec = F.struct(*[F.col(c) for c in cols])
    out = df.groupBy(key).agg(F.max_by(rec, F.struct(F.col(ts), F.col(tiebreak))).alias("_r"))
    return out.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def history(df: DataFrame, key: str, ts: str, tiebreak: str) -> DataFrame:
    """All records of every key, newest first, with a 1-based ``seq`` per key.

    Uses the distributed running count, so the records of one hot key are numbered by many
    tasks rather than sorted in one.
    """
    order = [F.col(ts).desc(), F.col(tiebreak).desc()]
    r = running_total(df.where(F.col(key).isNotNull()), order, None, [key], totals=False)
    return r.withColumnRenamed("_rank", "seq")
