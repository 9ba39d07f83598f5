"""K23 health scores and the per-business metrics row that insights are written from."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import dround, ratio
from tillroll.operators import kpi
from tillroll.operators.topk import top_products
from tillroll.operators.windows import monthly_growth
from tillroll.plans.grains import Grains


def join_one(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on the keys; without keys the right side is an aggregate of at most one
    row (possibly none, e.g. no growth with a single month), broadcast by construction."""
    if by:
        return left.join(right, on=list(by), how="left")
    return left.join(F.broadcast(right), on=F.lit(True), how="left")


def metrics_row(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per business with the figures used by health scores and insights, from the stored aggregates of
    the rows (or from ``df`` itself if it is such)."""
    df = df if isinstance(df, Grains) else Grains(df, by, ("total", "month", "weekday", "customer", "product"))
    s = kpi.summary(df, by).select(*by, "total_revenue", "total_transactions", "total_customers",
                                   "total_products", "date_start", "date_end",
                                   dround("avg_transaction_value", 2).alias("avg_transaction_value"))
    c = kpi.customer_counts(df, by).select(*by, F.col("customer_count").cast("bigint").alias("customer_count"),
                                           F.col("one_time_customers").cast("bigint").alias("one_time_customers"),
                                           dround(ratio("_mean"), 2).alias("avg_customer_value"))
    p = kpi.product_counts(df, by).select(*by, F.col("total_products").cast("bigint").alias("product_rows"),
                                          dround(ratio("_mean"), 2).alias("avg_product_price"))
    g = monthly_growth(df, by).where("is_latest").select(*by, "revenue_mom", "revenue_trend")
    t = top_products(df, 1, by).select(*by, F.col("Description").alias("top_product_name"),
                                       F.col("total_revenue").alias("top_product_revenue"))
    b = kpi.seasonality(df, by).select(*by, "best_day")
    out = s
    for part in (c, p, g, t, b):
        out = join_one(out, part, by)
    return out.fillna({"customer_count": 0, "one_time_customers": 0, "product_rows": 0,
                       "avg_customer_value": 0.0})


def with_health(m: DataFrame) -> DataFrame:
    """Add the scores 0..100 from a metrics row (rules of the studied application):

    revenue 50, +10 if revenue > 10000, +10 if invoices > 100, + min(20, mom) if mom > 0,
    - min(10, |mom|) if mom < 0; customer 50, +20 if customers > 50 else +10 if > 10, +10 if
    one-time < half; product 50, +20 if products > 20 else +10 if > 5; each clamped to 0..100;
    overall = round(0.5 R + 0.3 C + 0.2 P, 1). A NULL growth changes nothing.
    """
    mom = F.col("revenue_mom")
    r = (F.lit(50.0) + F.when(F.col("total_revenue") > 10000, 10).otherwise(0)
         + F.when(F.col("total_transactions") > 100, 10).otherwise(0)
         + F.when(mom > 0, F.least(F.lit(20.0), mom)).when(mom < 0, -F.least(F.lit(10.0), F.abs(mom))).otherwise(0.0))
    cc = F.col("customer_count")
    c = (F.lit(50.0) + F.when(cc > 50, 20).when(cc > 10, 10).otherwise(0)
         + F.when(F.col("one_time_customers") < cc * 0.5, 10).otherwise(0))
    tp = F.col("product_rows")
    p = F.lit(50.0) + F.when(tp > 20, 20).when(tp > 5, 10).otherwise(0)

    def clamp(x):
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)).cast(T.DoubleType())

    out = m.withColumns({"revenue_health": clamp(r), "customer_health": clamp(c), "product_health": clamp(p)})
    overall = dround(F.col("revenue_health") * 0.5 + F.col("customer_health") * 0.3
                     + F.col("product_health") * 0.2, 1)
    return out.withColumn("overall_health", overall)


def health_from_metrics(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The scores alone."""
    return with_health(m).select(*by, "revenue_health", "customer_health", "product_health", "overall_health")


def health_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue / customer / product / overall health per business."""
    return health_from_metrics(metrics_row(df, by), by)
