"""Every KPI section as one long table ``(by..., section, metric, key, value, text)``.

Sections read the stored aggregates of the cleaned rows (:mod:`tillroll.plans.grains`: two passes over the
rows, whatever the number of sections) and are unioned; each becomes rows with ``inline`` over an array of
structs, so there is no driver loop over metrics. An empty input gives a single status row 'No data available'.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import kpi as K
from tillroll.operators import topk as T
from tillroll.operators.health import health_scores
from tillroll.operators.windows import monthly_growth
from tillroll.plans.grains import Grains

# (section, group, source, key column, numeric metrics, text metrics)
SPEC: list[tuple[str, str | None, str, str | None, list[str], list[str]]] = [
    ("summary", None, "summary", None,
     ["total_revenue", "total_transactions", "total_products", "total_customers", "total_items_sold",
      "avg_transaction_value", "avg_items_per_transaction", "days"], ["date_start", "date_end"]),
    ("revenue", "monthly_revenue", "monthly", "period", ["revenue"], []),
    ("revenue", "quarterly_revenue", "quarterly", "period", ["revenue"], []),
    ("revenue", "weekday_revenue", "weekday", "weekday", ["revenue"], []),
    ("revenue", "revenue_distribution", "distribution", None,
     ["min", "max", "mean", "median", "std", "p25", "p50", "p75", "p90"], []),
    ("customer", None, "customer_overview", None,
     ["customer_count", "active_customers", "one_time_customers", "avg_customer_value", "median_customer_value"], []),
    ("customer", "segment_distribution", "segments", "segment", ["customers"], []),
    ("customer", "rfm_summary", "rfm_summary", None, ["avg_recency", "avg_frequency", "avg_monetary"], []),
    ("customer", "top_customers", "top_customers", "CustomerID", ["total_spent", "transactions", "avg_value"], []),
    ("product", None, "product_overview", None,
     ["total_products", "unique_products_sold", "avg_product_price", "median_product_price", "min_price", "max_price"], []),
    ("product", "top_products", "top_products", "StockCode",
     ["total_revenue", "total_quantity", "transaction_count", "avg_price"], ["Description"]),
    ("time_series", "weekly_pattern", "weekday_pattern", "weekday", ["mean_revenue"], []),
    ("time_series", "seasonality", "seasonality", None, ["weekly_variation"], ["best_day", "worst_day"]),
    ("geographic", None, "geo_overview", None, ["countries_covered", "international_percentage"], []),
    ("geographic", "top_countries", "top_countries", "Country", ["total_revenue", "transactions", "customers"], []),
    ("growth", None, "growth", None, ["revenue_mom"], ["revenue_trend"]),
    ("health_scores", None, "health", None, ["revenue_health", "customer_health", "product_health", "overall_health"], []),
]

SOURCES: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {
    "summary": K.summary,
    "monthly": K.monthly_revenue,
    "quarterly": K.quarterly_revenue,
    "weekday": K.weekday_revenue,
    "distribution": K.revenue_distribution,
    "customer_overview": K.customer_overview,
    "segments": K.segment_distribution,
    "rfm_summary": K.rfm_summary,
    "top_customers": lambda df, by: T.top_customers(df, by=by),
    "product_overview": K.product_overview,
    "top_products": lambda df, by: T.top_products(df, by=by),
    "weekday_pattern": K.weekday_pattern,
    "seasonality": K.seasonality,
    "geo_overview": K.geo_overview,
    "top_countries": lambda df, by: T.top_countries(df, by=by),
    "growth": lambda df, by: monthly_growth(df, by).where("is_latest"),
    "health": health_scores,
}


def long_metrics(df: DataFrame | Grains, by: Sequence[str] = (), health: DataFrame | None = None) -> DataFrame:
    """All sections as rows. ``df`` is a cleaned table or its stored aggregates; ``health`` may pass
    health scores already computed for these rows."""
    by = list(by)
    df = df if isinstance(df, Grains) else Grains(df, by, with_values=True)

    def part(spec: tuple) -> DataFrame:
        section, group, source, key, values, texts = spec
        src = health if (source == "health" and health is not None) else SOURCES[source](df, by)
        k = F.col(key).cast("string") if key else F.lit("")
        items = [F.struct(F.lit(section).alias("section"), F.lit(f"{group}.{m}" if group else m).alias("metric"),
                          k.alias("key"), F.col(m).cast("double").alias("value"),
                          F.lit(None).cast("string").alias("text")) for m in values]
        items += [F.struct(F.lit(section).alias("section"), F.lit(f"{group}.{m}" if group else m).alias("metric"),
                           k.alias("key"), F.lit(None).cast("double").alias("value"),
                           F.col(m).cast("string").alias("text")) for m in texts]
        return src.select(*by, F.inline(F.array(*items)))

    df.prepare()  # stored once, before the sections are planned side by side
    with ThreadPoolExecutor(max_workers=8) as pool:
        parts = list(pool.map(part, SPEC))
    empty = df.totals().where(F.col("_start").isNull() & F.col("_rev").isNull() & (F.col("total_transactions") == 0)) \
        .select(*by, F.lit("_metadata").alias("section"), F.lit("error").alias("metric"), F.lit("").alias("key"),
                F.lit(None).cast("double").alias("value"), F.lit("No data available").alias("text"))
    return reduce(DataFrame.unionByName, parts + [empty])


def metric_count(long_df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of computed metrics (non-null numbers or texts, metadata excluded)."""
    m = long_df.where((F.col("section") != "_metadata") & (F.col("value").isNotNull() | F.col("text").isNotNull()))
    return m.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("metric_count"))
