"""Synthetic retail transactions generated in parallel from ``spark.range``.

Attributes come from modular arithmetic on the row id (no random numbers, so the same
rows come out on every run and in SQL). As in the studied generator, product code, name
and price are drawn independently of each other.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.schema import PRICE_TYPE

# Catalogue, countries and customer range of the studied generator
PRODUCTS = [
    ("85123A", "WHITE HANGING HEART T-LIGHT HOLDER", "2.55"),
    ("71053", "WHITE METAL LANTERN", "3.39"),
    ("84406B", "CREAM CUPID HEARTS COAT HANGER", "2.75"),
    ("84029G", "KNITTED UNION FLAG HOT WATER BOTTLE", "3.75"),
    ("84030E", "KNITTED UNION FLAG HAT", "2.95"),
    ("84879", "ASSORTED COLOUR BIRD ORNAMENT", "1.69"),
    ("22745", "POPPY'S PLAYHOUSE BEDROOM", "2.10"),
    ("22746", "POPPY'S PLAYHOUSE KITCHEN", "2.10"),
    ("22747", "POPPY'S PLAYHOUSE LIVING ROOM", "2.10"),
    ("22748", "POPPY'S PLAYHOUSE BATHROOM", "2.10"),
    ("22749", "POTTERING BENCH", "2.10"),
    ("22750", "FELT TREE TRUNK", "2.10"),
]
COUNTRIES = ["United Kingdom", "Germany", "France", "Spain", "Italy", "USA", "Australia"]
N_CUSTOMERS = 500
START, END = "2023-01-01 00:00:00", "2023-12-31 00:00:00"
RETURN_EVERY = 50      # 2 % returns
NULL_CUSTOMER_EVERY = 20  # 5 % missing customers


def sample_transactions(spark: SparkSession, n_rows: int = 10000, num_partitions: int | None = None) -> DataFrame:
    i = F.col("id")
    codes = F.array(*[F.lit(p[0]) for p in PRODUCTS])
    names = F.array(*[F.lit(p[1]) for p in PRODUCTS])
    prices = F.array(*[F.lit(p[2]) for p in PRODUCTS])
    k = len(PRODUCTS)
    start = F.lit(START).cast(T.TimestampNTZType())
    span_us = int((datetime.fromisoformat(END) - datetime.fromisoformat(START)).total_seconds() * 1_000_000)
    step = span_us / (n_rows - 1) if n_rows > 1 else 0.0
    ts = F.timestamp_add("MICROSECOND", (i * F.lit(step)).cast("bigint"), start)
    qty = (1 + (i * 13) % 19).cast("double")
    base = spark.range(0, n_rows, 1, num_partitions)
    return base.select(
        F.format_string("INV%07d", i).alias("InvoiceNo"),
        F.element_at(codes, ((i * 7 + 3) % k + 1).cast("int")).alias("StockCode"),
        F.element_at(names, ((i * 5 + 1) % k + 1).cast("int")).alias("Description"),
        F.when((i * 37) % RETURN_EVERY == 0, -qty).otherwise(qty).alias("Quantity"),
        ts.cast(T.TimestampNTZType()).alias("InvoiceDate"),
        F.element_at(prices, ((i * 11 + 5) % k + 1).cast("int")).cast(PRICE_TYPE).alias("UnitPrice"),
        F.when((i * 23) % NULL_CUSTOMER_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(F.format_string("CUST%05d", ((i * 17) % N_CUSTOMERS + 1))).alias("CustomerID"),
        F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), ((i * 3) % len(COUNTRIES) + 1).cast("int")).alias("Country"),
    )
