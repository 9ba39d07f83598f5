"""Report tables: formatted figures for display or export (the dashboard's tables)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import fmt_currency, fmt_label, fmt_number
from tillroll.operators.topk import top_customers, top_products


def percentile_rows(df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """percentile columns -> rows (label, value), e.g. {'25th': 'p25', ...}."""
    stack = "stack({}, {}) as (percentile, value)".format(
        len(columns), ", ".join(f"'{label}', `{col}`" for label, col in columns.items()))
    return df.selectExpr(*by, stack)


def top_customers_table(df: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """top customers: id cut to 8 characters + '...', spend as currency, invoices."""
    t = top_customers(df, n, by)
    return t.select(*by, "rank", F.concat(F.substring("CustomerID", 1, 8), F.lit("...")).alias("Customer"),
                    fmt_currency("total_spent").alias("Spent"), F.col("transactions").alias("Transactions"))


def top_products_table(df: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """top products with names cut to 30 characters + '...' when longer."""
    t = top_products(df, n, by)
    return t.select(*by, "rank", fmt_label(F.col("Description"), 30, "Unknown Product").alias("Product"),
                    F.col("total_revenue").alias("Revenue"), F.col("total_quantity").alias("Quantity"),
                    F.col("transaction_count").alias("Transactions"))


def formatted(df: DataFrame, currency: Sequence[str] = (), numbers: Sequence[str] = (),
              labels: Sequence[str] = (), width: int = 30) -> DataFrame:
    """F1-F3 applied to chosen columns: currency text, integer text, shortened labels."""
    cols = {c: fmt_currency(c) for c in currency}
    cols.update({c: fmt_number(c) for c in numbers})
    cols.update({c: fmt_label(F.col(c), width) for c in labels})
    return df.withColumns(cols)
