"""KPIs over a cleaned transaction table. Every operator accepts ``by`` grouping keys.

Money stays DECIMAL until the output column, where it is rounded to 2 digits and typed
DOUBLE; means, percentiles and rates are rounded to 4 digits. Sums over decimals are exact,
so results do not depend on partitioning or task order.

Deliberate deviations: groups with NULL keys are dropped like pandas ``groupby`` does;
average transaction value divides the exact sums and rounds last; customers and products
are keyed by their ids (not by row numbers).

Where an operator takes a cleaned table it also takes the stored aggregates of one (:class:`Grains`, with
the same ``by``), so that many sections share one pass over the rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import money, ratio, safe_div
from tillroll.plans.grains import Grains, known
from tillroll.plans.groups import attach
from tillroll.plans.quantiles import percentiles
from tillroll.schema import SEGMENTS, WEEKDAYS


def _dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(T.DoubleType())


def _mean(col: str) -> Column:
    """Mean as exact sum / count in DOUBLE (same arithmetic in every engine)."""
    return safe_div(F.sum(col).cast(T.DoubleType()), F.count(col))


def _nonnull(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def weekday_dim(spark) -> DataFrame:
    """The 7 weekdays with their order (Monday = 1)."""
    return spark.createDataFrame([(d, i + 1) for i, d in enumerate(WEEKDAYS)], "weekday string, day_index int")


# ----------------------------------------------------------------------- K1 summary
def totals_raw(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    if isinstance(df, Grains):
        return df.totals()
    return df.groupBy(*by).agg(
        F.sum("Revenue").alias("_rev"),
        F.count_distinct("InvoiceNo").alias("total_transactions"),
        F.count_distinct("StockCode").alias("total_products"),
        F.count_distinct("CustomerID").alias("total_customers"),
        F.sum("Quantity").alias("_items"),
        F.min("InvoiceDate").alias("_start"), F.max("InvoiceDate").alias("_end"))


def summary(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    """K1: revenue, distinct invoices / products / customers, items, averages, date range."""
    a = totals_raw(df, by)
    tx = F.col("total_transactions")
    return a.select(
        *by,
        money("_rev").alias("total_revenue"),
        tx.cast("bigint").alias("total_transactions"),
        F.col("total_products").cast("bigint").alias("total_products"),
        F.col("total_customers").cast("bigint").alias("total_customers"),
        F.col("_items").cast("bigint").alias("total_items_sold"),
        ratio(F.coalesce(safe_div(_dbl("_rev"), tx), F.lit(0.0))).alias("avg_transaction_value"),
        ratio(F.coalesce(safe_div(F.col("_items"), tx), F.lit(0.0))).alias("avg_items_per_transaction"),
        F.date_format("_start", "yyyy-MM-dd").alias("date_start"),
        F.date_format("_end", "yyyy-MM-dd").alias("date_end"),
        F.coalesce(F.timestamp_diff("DAY", F.col("_start"), F.col("_end")), F.lit(0)).cast("bigint").alias("days"))


# ----------------------------------------------------------------------- K2-K5 revenue
def monthly_raw(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    return df.months() if isinstance(df, Grains) else df.groupBy(*by, "Year", "Month").agg(F.sum("Revenue").alias("_rev"))


def monthly_revenue(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    """K2: revenue per year-month, label ``YYYY-MM``."""
    return (monthly_raw(df, by)
            .select(*by, F.format_string("%d-%02d", "Year", "Month").alias("period"),
                    money("_rev").alias("revenue")))


def quarterly_revenue(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    """K3: revenue per quarter, label ``Qn YYYY``."""
    if isinstance(df, Grains):
        quarter = F.ceil(F.col("Month") / 3).cast("int").alias("Quarter")
        q = df.months().groupBy(*by, "Year", quarter).agg(F.sum("_rev").alias("_rev"))
    else:
        q = df.groupBy(*by, "Year", "Quarter").agg(F.sum("Revenue").alias("_rev"))
    return (q.select(*by, F.format_string("Q%d %d", "Quarter", "Year").alias("period"),
                    money("_rev").alias("revenue")))


def reindex(agg: DataFrame, labels: DataFrame, label_col: str, by: Sequence[str] = (),
            groups: DataFrame | None = None) -> DataFrame:
    """Align an aggregate to a fixed label list (missing labels -> NULL values).

    The label list is small and bounded (7 weekdays, 12 months, 4 segments), so it is the
    broadcast side; with ``by`` every group is crossed with the labels.
    """
    if by:
        g = groups if groups is not None else agg.select(*by).distinct()
        frame = g.crossJoin(F.broadcast(labels))
        return frame.join(agg, on=[*by, label_col], how="left")
    return F.broadcast(labels).join(agg, on=[label_col], how="left")


def weekday_raw(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    if isinstance(df, Grains):
        return df.weekdays()
    return (df.groupBy(*by, F.col("Weekday").alias("weekday"))
            .agg(F.sum("Revenue").alias("_sum"), F.count(F.lit(1)).alias("_n"), _mean("Revenue").alias("_mean")))


def weekday_revenue(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    """K4: revenue per weekday, all 7 days, missing days -> 0."""
    agg = weekday_raw(df, by).select(*by, "weekday", F.col("_sum").alias("_rev"))
    out = reindex(agg, weekday_dim(df.sparkSession), "weekday", by, _nonnull(agg, by).select(*by).distinct())
    return out.select(*by, "weekday", F.col("day_index").cast("bigint").alias("day_index"),
                      money(F.coalesce(F.col("_rev"), F.lit(0))).alias("revenue"))


def revenue_distribution(df: DataFrame | Grains, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """K5: min, max, mean, median, sample std and p25/p50/p75/p90 of row revenue."""
    if isinstance(df, Grains):
        base = df.spread()
        q = df.quantiles("revenue", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    else:
        base = df.groupBy(*by).agg(F.min("Revenue").alias("_min"), F.max("Revenue").alias("_max"),
                                   _mean("Revenue").alias("_mean"),
                                   F.stddev_samp(_dbl("Revenue")).alias("_std"))
        q = percentiles(df, "Revenue", [0.25, 0.5, 0.75, 0.9], by, accuracy=accuracy)
    j = base.crossJoin(q) if not by else base.join(q, on=list(by))
    return j.select(*by, money("_min").alias("min"), money("_max").alias("max"),
                    ratio("_mean").alias("mean"), ratio("p50").alias("median"),
                    ratio("_std").alias("std"), ratio("p25").alias("p25"), ratio("p50").alias("p50"),
                    ratio("p75").alias("p75"), ratio("p90").alias("p90"))


# ----------------------------------------------------------------------- K6-K11 customers
def known_customers(df: DataFrame) -> DataFrame:
    """Rows of identified customers."""
    return df.where(known())


def customer_spend_raw(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per customer: exact spend (DECIMAL), distinct invoices, items."""
    if isinstance(df, Grains):
        return df.customers()
    return (known_customers(df).groupBy(*by, "CustomerID")
            .agg(F.sum("Revenue").alias("_spent"), F.count_distinct("InvoiceNo").alias("_tx"),
                 F.sum("Quantity").alias("_items"), F.max("InvoiceDate").alias("_last")))


def customer_spend(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K6: spent, distinct invoices, items and average per invoice of every customer."""
    return customer_spend_raw(df, by).select(
        *by, "CustomerID", money("_spent").alias("total_spent"),
        F.col("_tx").cast("bigint").alias("transaction_count"),
        F.col("_items").cast("bigint").alias("total_items"),
        ratio(F.coalesce(safe_div(_dbl("_spent"), F.col("_tx")), F.lit(0.0))).alias("avg_transaction_value"))


def segment_edges(df: DataFrame | Grains, spend: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quartile edges (0, .25, .5, .75, 1) of customer spend per group."""
    edges = {"_e0": 0.0, "_e1": 0.25, "_e2": 0.5, "_e3": 0.75, "_e4": 1.0}
    if isinstance(df, Grains):
        return df.quantiles("spend", edges)
    return percentiles(spend, "total_spent", list(edges.values()), by, names=list(edges))


def customer_segments(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K7: Low / Medium / High / VIP by right-closed quartile cuts of spend.

    Ties are never split (value cuts, not ``ntile``). When two edges coincide the cut is
    impossible and every customer of the group is 'Medium', as in the studied code.
    """
    spend = customer_spend(df, by)
    x = attach(spend, segment_edges(df, spend, by), by)
    distinct = (F.col("_e0") < F.col("_e1")) & (F.col("_e1") < F.col("_e2")) & \
               (F.col("_e2") < F.col("_e3")) & (F.col("_e3") < F.col("_e4"))
    v = F.col("total_spent")
    label = (F.when(~distinct, F.lit("Medium"))
             .when(v <= F.col("_e1"), F.lit(SEGMENTS[0])).when(v <= F.col("_e2"), F.lit(SEGMENTS[1]))
             .when(v <= F.col("_e3"), F.lit(SEGMENTS[2])).otherwise(F.lit(SEGMENTS[3])))
    return x.select(*by, "CustomerID", "total_spent", label.alias("segment"))


def segment_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K8: customers per segment, empty segments kept with 0."""
    seg = customer_segments(df, by)
    agg = seg.groupBy(*by, "segment").agg(F.count(F.lit(1)).alias("_n"))
    dim = df.sparkSession.createDataFrame([(s,) for s in SEGMENTS], "segment string")
    out = reindex(agg, dim, "segment", by, seg.select(*by).distinct())
    return out.select(*by, "segment", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("customers"))


def _recency(df: DataFrame | Grains, by: Sequence[str]) -> DataFrame:
    """Customers with the last date of their group."""
    per = customer_spend_raw(df, by)
    dated = (per.select(*by, F.col("_last").alias("InvoiceDate")) if isinstance(df, Grains) else known_customers(df))
    return attach(per, dated.groupBy(*by).agg(F.max("InvoiceDate").alias("_ref")), by)


def rfm(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K9: recency (whole days before the group's last date), frequency, monetary."""
    x = _recency(df, by)
    return x.select(*by, "CustomerID",
                    F.timestamp_diff("DAY", F.col("_last"), F.col("_ref")).cast("bigint").alias("recency"),
                    F.col("_tx").cast("bigint").alias("frequency"), money("_spent").alias("monetary"))


def rfm_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean recency, frequency and monetary value."""
    x = _recency(df, by).withColumn(
        "recency", F.timestamp_diff("DAY", F.col("_last"), F.col("_ref")))
    return x.groupBy(*by).agg(ratio(_mean("recency")).alias("avg_recency"),
                              ratio(_mean("_tx")).alias("avg_frequency"),
                              ratio(_mean("_spent")).alias("avg_monetary"))


def customer_counts(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    return customer_spend_raw(df, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.count_if(F.col("_tx") > 1).alias("active_customers"),
        F.count_if(F.col("_tx") == 1).alias("one_time_customers"),
        _mean("_spent").alias("_mean"))


def customer_overview(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    """Customers, repeat (>1 invoice), one-time (=1), mean / median value, one-time %."""
    if isinstance(df, Grains):
        med = df.quantiles("spend", {"_median": 0.5})
    else:
        spend = customer_spend_raw(df, by).withColumn("total_spent", money("_spent"))
        med = percentiles(spend, "total_spent", [0.5], by, names=["_median"])
    a = customer_counts(df, by)
    j = a.crossJoin(med) if not by else a.join(med, on=list(by))
    return j.select(*by, F.col("customer_count").cast("bigint").alias("customer_count"),
                    F.col("active_customers").cast("bigint").alias("active_customers"),
                    F.col("one_time_customers").cast("bigint").alias("one_time_customers"),
                    ratio("_mean").alias("avg_customer_value"), ratio("_median").alias("median_customer_value"),
                    ratio(F.coalesce(safe_div(F.col("one_time_customers") * 100.0, F.col("customer_count")),
                                     F.lit(0.0))).alias("one_time_pct"))


def repeat_customers(df: DataFrame, by: Sequence[str] = (), repeat: bool = True) -> DataFrame:
    """Customers with more than one invoice (``repeat``) or exactly one."""
    spend = customer_spend(df, by)
    cond = F.col("transaction_count") > 1 if repeat else F.col("transaction_count") == 1
    return spend.where(cond)


# ----------------------------------------------------------------------- K12-K13 products
def product_performance_raw(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    if isinstance(df, Grains):
        return df.products()
    return (_nonnull(df, ["StockCode", "Description"]).groupBy(*by, "StockCode", "Description")
            .agg(F.sum("Revenue").alias("_rev"), F.sum("Quantity").alias("_qty"),
                 F.count_distinct("InvoiceNo").alias("_tx")))


def product_performance(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (code, description): revenue, quantity, distinct invoices, average price."""
    return product_performance_raw(df, by).select(
        *by, "StockCode", "Description", money("_rev").alias("total_revenue"),
        F.col("_qty").cast("bigint").alias("total_quantity"), F.col("_tx").cast("bigint").alias("transaction_count"),
        ratio(F.coalesce(safe_div(_dbl("_rev"), F.col("_qty")), F.lit(0.0))).alias("avg_price"))


def product_counts(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    p = product_performance(df, by)
    return p.groupBy(*by).agg(F.count(F.lit(1)).alias("total_products"),
                           F.count_distinct("StockCode").alias("unique_products_sold"),
                           _mean("avg_price").alias("_mean"), F.min("avg_price").alias("min_price"),
                           F.max("avg_price").alias("max_price"))


def product_overview(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    """Product rows, distinct codes, mean / median / min / max average price."""
    if isinstance(df, Grains):
        med = df.quantiles("price", {"_median": 0.5})
    else:
        med = percentiles(product_performance(df, by), "avg_price", [0.5], by, names=["_median"])
    a = product_counts(df, by)
    j = a.crossJoin(med) if not by else a.join(med, on=list(by))
    return j.select(*by, F.col("total_products").cast("bigint").alias("total_products"),
                    F.col("unique_products_sold").cast("bigint").alias("unique_products_sold"),
                    ratio("_mean").alias("avg_product_price"), ratio("_median").alias("median_product_price"),
                    ratio("min_price").alias("min_price"), ratio("max_price").alias("max_price"))


# ----------------------------------------------------------------------- K14-K16 time
def daily_raw(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*by, "Date").agg(F.sum("Revenue").alias("_rev"),
                                        F.count_distinct("InvoiceNo").alias("_tx"),
                                        F.count_distinct("CustomerID").alias("_cust"),
                                        F.sum("Quantity").alias("_items")))


def daily(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per day revenue, distinct invoices, distinct customers, items."""
    return daily_raw(df, by).select(*by, "Date", money("_rev").alias("daily_revenue"),
                                    F.col("_tx").cast("bigint").alias("daily_transactions"),
                                    F.col("_cust").cast("bigint").alias("daily_customers"),
                                    F.col("_items").cast("bigint").alias("daily_items"))


def weekday_pattern(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue sum, row count and mean per weekday, Monday..Sunday; missing -> NULL."""
    agg = weekday_raw(df, by)
    out = reindex(agg, weekday_dim(df.sparkSession), "weekday", by, _nonnull(agg, by).select(*by).distinct())
    return out.select(*by, "weekday", F.col("day_index").cast("bigint").alias("day_index"),
                      money("_sum").alias("total_revenue"), F.col("_n").cast("bigint").alias("transaction_rows"),
                      ratio("_mean").alias("mean_revenue"))


def seasonality(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best and worst weekday by mean revenue (ties -> earlier weekday), variation %.

    Variation = (max mean - min mean) / mean of the weekday means x 100, 0 if that mean <= 0.
    """
    agg = weekday_raw(df, by).select(*by, "weekday", "_mean")
    x = agg.join(F.broadcast(weekday_dim(df.sparkSession)), on="weekday").where(F.col("_mean").isNotNull())
    s = x.groupBy(*by).agg(
        F.max_by("weekday", F.struct(F.col("_mean"), -F.col("day_index"))).alias("best_day"),
        F.min_by("weekday", F.struct(F.col("_mean"), F.col("day_index"))).alias("worst_day"),
        F.max("_mean").alias("_hi"), F.min("_mean").alias("_lo"), F.avg("_mean").alias("_avg"))
    var = F.when(F.col("_avg") > 0, (F.col("_hi") - F.col("_lo")) / F.col("_avg") * 100).otherwise(F.lit(0.0))
    return s.select(*by, "best_day", "worst_day", ratio(var).alias("weekly_variation"))


# ----------------------------------------------------------------------- K17-K20
def country_raw(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    if isinstance(df, Grains):
        return df.countries()
    keys = list(dict.fromkeys([*by, "Country"]))
    return (_nonnull(df, ["Country"]).groupBy(*keys)
            .agg(F.sum("Revenue").alias("_rev"), F.count_distinct("InvoiceNo").alias("_tx"),
                 F.count_distinct("CustomerID").alias("_cust"), F.sum("Quantity").alias("_qty")))


def country_performance(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    """Per country revenue, distinct invoices, distinct customers, quantity."""
    return (country_raw(df, by)
            .select(*by, "Country", money("_rev").alias("total_revenue"),
                    F.col("_tx").cast("bigint").alias("transaction_count"),
                    F.col("_cust").cast("bigint").alias("customer_count"),
                    F.col("_qty").cast("bigint").alias("total_quantity")))


def geo_overview(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Countries covered and revenue share outside the top country (0 with one country)."""
    c = country_raw(df, by).select(*by, "_rev")
    a = c.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max("_rev").alias("_top"),
                           F.sum("_rev").alias("_total"))
    share = F.when(F.col("_n") > 1, (1 - safe_div(_dbl("_top"), _dbl("_total"))) * 100).otherwise(F.lit(0.0))
    return a.select(*by, F.col("_n").cast("bigint").alias("countries_covered"),
                    ratio(share).alias("international_percentage"))


def month_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per calendar month: revenue sum, row count, mean revenue."""
    m = F.date_trunc("month", F.col("InvoiceDate"))
    return (df.groupBy(*by, m.alias("_m"))
            .agg(F.sum("Revenue").alias("_sum"), F.count(F.lit(1)).alias("_n"), _mean("Revenue").alias("_mean"))
            .select(*by, F.date_format("_m", "yyyy-MM").alias("month"), money("_sum").alias("total_revenue"),
                    F.col("_n").cast("bigint").alias("transaction_count"), ratio("_mean").alias("avg_transaction")))


def sales_vs_returns(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Value and row count of sales and of returns; return share of rows (%)."""
    a = df.groupBy(*by).agg(F.sum("SalesRevenue").alias("_s"), F.sum("ReturnsValue").alias("_r"),
                            F.count_if(~F.col("IsReturn")).alias("_ns"), F.count_if(F.col("IsReturn")).alias("_nr"),
                            F.count(F.lit(1)).alias("_n"))
    return a.select(*by, money("_s").alias("sales_value"), money("_r").alias("returns_value"),
                    F.col("_ns").cast("bigint").alias("sales_rows"), F.col("_nr").cast("bigint").alias("return_rows"),
                    ratio(F.coalesce(safe_div(F.col("_nr") * 100.0, F.col("_n")), F.lit(0.0))).alias("return_row_pct"))
