"""Top-k reports. Without ``by`` a global ``orderBy().limit()`` plans as
TakeOrderedAndProject (a per-task top-k, then one small merge); with ``by`` a
``row_number() <= k`` filter plans as WindowGroupLimit, which also trims each task's
candidates before the shuffle, so a hot group sends at most k rows per task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.kpi import country_performance, customer_spend, product_performance
from tillroll.schema import TOP_COUNTRIES, TOP_CUSTOMERS, TOP_PERFORMERS, TOP_PRODUCTS


def top_n(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows ranked 1..n by ``order`` (a total order) within each ``by`` group, with ``rank``."""
    if not by:
        head = df.orderBy(*order).limit(n)
        # n rows at most: numbering them in one task is bounded by n.
        return head.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def top_customers(df: DataFrame, n: int = TOP_CUSTOMERS, by: Sequence[str] = ()) -> DataFrame:
    """Top customers by spend (ties -> smaller CustomerID) with three figures."""
    c = customer_spend(df, by)
    t = top_n(c, [F.col("total_spent").desc(), F.col("CustomerID").asc()], n, by)
    return t.select(*by, "rank", "CustomerID", "total_spent",
                    F.col("transaction_count").alias("transactions"),
                    F.col("avg_transaction_value").alias("avg_value"))


def top_products(df: DataFrame, n: int = TOP_PRODUCTS, by: Sequence[str] = ()) -> DataFrame:
    """Top products by revenue with five figures."""
    p = product_performance(df, by)
    t = top_n(p, [F.col("total_revenue").desc(), F.col("StockCode").asc(), F.col("Description").asc()], n, by)
    return t.select(*by, "rank", "StockCode", "Description", "total_revenue", "total_quantity",
                    "transaction_count", "avg_price")


def top_countries(df: DataFrame, n: int = TOP_COUNTRIES, by: Sequence[str] = ()) -> DataFrame:
    """Top countries by revenue."""
    c = country_performance(df, by)
    t = top_n(c, [F.col("total_revenue").desc(), F.col("Country").asc()], n, by)
    return t.select(*by, "rank", "Country", "total_revenue", F.col("transaction_count").alias("transactions"),
                    F.col("customer_count").alias("customers"))


def top_performers(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """T4: first 5 products, 5 customers and 3 countries as rows ``(kind, rank, id)``."""
    p = top_products(df, TOP_PERFORMERS["products"], by).select(
        *by, F.lit("products").alias("kind"), "rank", F.col("StockCode").alias("id"))
    c = top_customers(df, TOP_PERFORMERS["customers"], by).select(
        *by, F.lit("customers").alias("kind"), "rank", F.col("CustomerID").alias("id"))
    g = top_countries(df, TOP_PERFORMERS["countries"], by).select(
        *by, F.lit("countries").alias("kind"), "rank", F.col("Country").alias("id"))
    return p.unionByName(c).unionByName(g)


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100,
         with_total: bool = True) -> DataFrame:
    """T5: one page of a newest-first listing (``offset`` + ``limit``), with ``position``
    and, unlike the studied listing whose 'total' was the page length, the true total."""
    p = df.orderBy(*order).offset(skip).limit(limit)
    p = p.withColumn("position", (F.row_number().over(Window.orderBy(*order)) + skip).cast("bigint"))
    if with_total:
        p = p.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))
    return p


def frequency_head(df: DataFrame, n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` transaction-frequency classes (customers per invoice count)."""
    c = customer_spend(df, by)
    f = c.groupBy(*by, "transaction_count").agg(F.count(F.lit(1)).cast("bigint").alias("customers"))
    return top_n(f, [F.col("transaction_count").asc()], n, by).drop("rank")
