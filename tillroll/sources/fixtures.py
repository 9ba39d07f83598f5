"""Retail transaction tables derived from the TPC-H style test tables.

``sales``: clean transactions, ``dirty``: the same rows as text with injected faults.
Each has a Spark builder and the equivalent DuckDB SQL (used by the oracle), kept side by
side so that the two stay in step. Fault positions are fixed by modular arithmetic on the
order key, so both engines see the same faults without random numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import shuffle_partitions
from tillroll.sources.tables import table

CENTS = T.DecimalType(18, 2)  # the type of prices in the given tables
LINES_A_TASK = 1_000_000
ROWS_TO_SEND = 65_536  # rows of the smaller side of a join that are broadcast


def _joined(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part (all inner, all on keys).

    The dimension side is assembled first (customer ⋈ nation), so the big fact join is a
    single sort-merge equi-join on the order key; for the other joins AQE picks a
    broadcast only when the runtime size of a side is under the broadcast threshold.
    ``nation`` (25 rows by the TPC-H specification) and ``region`` (5) are bounded and
    broadcast.
    """
    # lineitem x orders is a large-by-large join on the order key: sort-merge it (both
    # sides shuffled on the key). Without the hint AQE may broadcast a small test
    # lineitem and stream everything from a one-task dimension scan.
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity",
               "l_extendedprice", "l_returnflag").hint("merge")
    od = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    cu_cols = ["c_custkey", "c_nationkey"] + (["c_mktsegment"] if keyed else [])
    cu = table(spark, sf_dir, "customer", *cu_cols)
    na_cols = ["n_nationkey", "n_name"] + (["n_regionkey"] if keyed else [])
    na = table(spark, sf_dir, "nation", *na_cols)
    if keyed:
        rg = table(spark, sf_dir, "region", "r_regionkey", "r_name")
        na = na.join(F.broadcast(rg), na.n_regionkey == rg.r_regionkey)
    pa = table(spark, sf_dir, "part", "p_partkey", "p_name")
    cust = cu.join(F.broadcast(na), cu.c_nationkey == na.n_nationkey)
    tasks = -(-li.count() // LINES_A_TASK)
    many = tasks > min(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))  # AQE may leave no more tasks than cores
    if many:
        # Neither orders by customer nor lines by part are sorted: they pass by the rows of the smaller side, so that a
        # task's memory does not grow with them, nor with a hot customer or part.
        cust, pa = cust.hint("shuffle_hash"), _beside_many(pa)
    orders = od.join(cust, od.o_custkey == cust.c_custkey)
    if many:  # so many tasks that each sorts a bounded number of lines
        li, orders = li.repartition(tasks, "l_orderkey").hint("merge"), orders.repartition(tasks, "o_orderkey")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).join(pa, li.l_partkey == pa.p_partkey)


def _beside_many(side: DataFrame) -> DataFrame:
    """The smaller side of a join with many rows: sent whole to the tasks if it has few rows, else hashed in shuffled shares."""
    return F.broadcast(side) if side.limit(ROWS_TO_SEND + 1).count() <= ROWS_TO_SEND else side.hint("shuffle_hash")


def _signed_qty() -> Column:
    return F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))


def sales(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """Clean transactions in the raw schema. ``keyed`` adds ``Region`` and ``Segment``."""
    j = _joined(spark, sf_dir, keyed)
    cols = [
        F.col("l_orderkey").cast("string").alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"),
        _signed_qty().cast(T.DoubleType()).alias("Quantity"),
        F.col("o_orderdate").cast(T.TimestampNTZType()).alias("InvoiceDate"),
        F.col("l_extendedprice").cast(CENTS).alias("UnitPrice"),
        F.col("o_custkey").cast("string").alias("CustomerID"),
        F.col("n_name").alias("Country"),
    ]
    if keyed:
        cols += [F.col("r_name").alias("Region"), F.col("c_mktsegment").alias("Segment")]
    return j.select(*cols)


def _date_text(k: Column) -> Column:
    """The order date as text: mostly day first, at fixed places in three other shapes."""
    t = F.col("o_orderdate").cast(T.TimestampNTZType())
    return (F.when(k % 67 == 0, F.date_format(t, "yyyy/MM/dd HH:mm")).when(k % 71 == 0, F.date_format(t, "d MMM yyyy HH:mm"))
            .when(k % 73 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(t, "dd/MM/yyyy HH:mm")))


def dirty(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """The ``sales`` rows as text with faults; rows with ``k % 50 = 0`` appear twice. ``keyed`` adds ``Region``."""
    j = _joined(spark, sf_dir, keyed)
    k = F.col("l_orderkey")
    q = _signed_qty()
    price = F.col("l_extendedprice").cast(CENTS)
    base = j.select(
        k.alias("_k"),
        k.cast("string").alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.when(k % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("Description"),
        F.when(k % 41 == 0, F.lit("n/a")).when(k % 43 == 0, F.lit(None).cast("string"))
         .when(k % 47 == 0, F.lit("0")).when(k % 983 == 0, F.lit("1000000000000000")).when(k % 991 == 0, (q * 100).cast("bigint").cast("string"))
         .otherwise(q.cast("bigint").cast("string")).alias("Quantity"),
        F.when(k % 53 == 0, F.lit("invalid")).otherwise(_date_text(k)).alias("InvoiceDate"),
        F.when(k % 59 == 0, F.lit("-1.00")).when(k % 61 == 0, F.lit(None).cast("string")).when(k % 79 == 0, F.lit("0.004"))
         .when(k % 997 == 0, (price * 10).cast("string")).otherwise(price.cast("string")).alias("UnitPrice"),
        F.when(k % 20 == 0, F.lit(None).cast("string")).otherwise(F.col("o_custkey").cast("string"))
         .alias("CustomerID"),
        F.when(k % 33 == 0, F.lit(None).cast("string"))
         .when(k % 7 == 0, F.concat(F.lit(" "), F.lower(F.col("n_name")))).otherwise(F.col("n_name"))
         .alias("Country"),
        *([F.col("r_name").alias("Region")] if keyed else []),
    )
    # One pass: rows with k % 50 = 0 are emitted twice by an explode, not by a self-union
    # that would evaluate the joins a second time.
    copies = F.when(F.col("_k") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return base.withColumn("_copy", F.explode(copies)).drop("_k", "_copy")


# ---------------------------------------------------------------------------------------
# The same tables in DuckDB SQL (views lineitem, orders, ... are registered by the driver)
# ---------------------------------------------------------------------------------------
_JOIN_SQL = """
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey"""

SALES_SQL = f"""sales AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS InvoiceNo,
         CAST(l.l_partkey AS VARCHAR) AS StockCode,
         p.p_name AS Description,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS DOUBLE) AS Quantity,
         CAST(o.o_orderdate AS TIMESTAMP) AS InvoiceDate,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS UnitPrice,
         CAST(o.o_custkey AS VARCHAR) AS CustomerID,
         n.n_name AS Country{_JOIN_SQL})"""

SALES_KEYED_SQL = f"""sales AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS InvoiceNo,
         CAST(l.l_partkey AS VARCHAR) AS StockCode,
         p.p_name AS Description,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS DOUBLE) AS Quantity,
         CAST(o.o_orderdate AS TIMESTAMP) AS InvoiceDate,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS UnitPrice,
         CAST(o.o_custkey AS VARCHAR) AS CustomerID,
         n.n_name AS Country,
         r.r_name AS Region,
         c.c_mktsegment AS Segment{_JOIN_SQL}
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

DIRTY_SQL = f"""dirty_base AS (
  SELECT l.l_orderkey AS k,
    CAST(l.l_orderkey AS VARCHAR) AS InvoiceNo,
    CAST(l.l_partkey AS VARCHAR) AS StockCode,
    CASE WHEN l.l_orderkey % 17 = 0 THEN NULL ELSE ' ' || p.p_name || ' ' END AS Description,
    CASE WHEN l.l_orderkey % 41 = 0 THEN 'n/a'
         WHEN l.l_orderkey % 43 = 0 THEN NULL
         WHEN l.l_orderkey % 47 = 0 THEN '0'
         WHEN l.l_orderkey % 983 = 0 THEN '1000000000000000'
         WHEN l.l_orderkey % 991 = 0 THEN CAST(CAST((CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END) * 100 AS BIGINT) AS VARCHAR)
         ELSE CAST(CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS BIGINT) AS VARCHAR) END AS Quantity,
    CASE WHEN l.l_orderkey % 53 = 0 THEN 'invalid'
         WHEN l.l_orderkey % 67 = 0 THEN strftime(CAST(o.o_orderdate AS TIMESTAMP), '%Y/%m/%d %H:%M')
         WHEN l.l_orderkey % 71 = 0 THEN strftime(CAST(o.o_orderdate AS TIMESTAMP), '%-d %b %Y %H:%M')
         WHEN l.l_orderkey % 73 = 0 THEN strftime(CAST(o.o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ')
         ELSE strftime(CAST(o.o_orderdate AS TIMESTAMP), '%d/%m/%Y %H:%M') END AS InvoiceDate,
    CASE WHEN l.l_orderkey % 59 = 0 THEN '-1.00'
         WHEN l.l_orderkey % 61 = 0 THEN NULL
         WHEN l.l_orderkey % 79 = 0 THEN '0.004'
         WHEN l.l_orderkey % 997 = 0 THEN CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 10 AS VARCHAR)
         ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS UnitPrice,
    CASE WHEN l.l_orderkey % 20 = 0 THEN NULL ELSE CAST(o.o_custkey AS VARCHAR) END AS CustomerID,
    CASE WHEN l.l_orderkey % 33 = 0 THEN NULL
         WHEN l.l_orderkey % 7 = 0 THEN ' ' || lower(n.n_name)
         ELSE n.n_name END AS Country{_JOIN_SQL}),
dirty AS (
  SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country FROM dirty_base
  UNION ALL
  SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country FROM dirty_base
  WHERE k % 50 = 0)"""
