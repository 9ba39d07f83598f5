"""Input tables of the registered queries, in Spark and in SQL.

* ``tx``     : ``sales`` with revenue columns and date parts (C8, C10)
* ``keyed``  : the same with ``Region`` and ``Segment`` (for ``by`` queries)
* ``dirty``  : the faulty text table; ``prepared`` (C1, C2, C4), ``valid`` (C5, C7),
               ``cleaned`` (the whole chain, C17)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators import clean as C
from tillroll.sources.fixtures import DIRTY_SQL, SALES_KEYED_SQL, SALES_SQL, dirty, sales


def tx(spark: SparkSession, sf: str) -> DataFrame:
    return C.date_parts(C.revenue_columns(sales(spark, sf)))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return C.date_parts(C.revenue_columns(sales(spark, sf, keyed=True)))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean(dirty(spark, sf))


def output(df: DataFrame) -> DataFrame:
    """Decimals -> DOUBLE, small integers -> BIGINT (the same types the SQL side yields)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast(T.DoubleType())
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast(T.LongType())
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------------------- SQL
def derive_sql(src: str, name: str) -> str:
    """C8 + C10 over ``src`` as CTE ``name``."""
    return f"""{name}_v AS (
  SELECT *, CAST(CAST(Quantity AS DECIMAL(20,6)) * CAST(UnitPrice AS DECIMAL(18,6)) AS DECIMAL(38,6)) AS TransactionValue FROM {src}),
{name} AS (
  SELECT *, Quantity < 0 AS IsReturn,
    CASE WHEN Quantity > 0 THEN TransactionValue ELSE 0 END AS SalesRevenue,
    CASE WHEN Quantity < 0 THEN abs(TransactionValue) ELSE 0 END AS ReturnsValue,
    (CASE WHEN Quantity > 0 THEN TransactionValue ELSE 0 END)
      - (CASE WHEN Quantity < 0 THEN abs(TransactionValue) ELSE 0 END) AS NetRevenue,
    (CASE WHEN Quantity > 0 THEN TransactionValue ELSE 0 END)
      - (CASE WHEN Quantity < 0 THEN abs(TransactionValue) ELSE 0 END) AS Revenue,
    year(InvoiceDate) AS Year, month(InvoiceDate) AS Month, monthname(InvoiceDate) AS MonthName,
    quarter(InvoiceDate) AS Quarter, dayname(InvoiceDate) AS Weekday, day(InvoiceDate) AS DayOfMonth,
    hour(InvoiceDate) AS Hour, CAST(InvoiceDate AS DATE) AS Date
  FROM {name}_v)"""


TITLE_SQL = ("array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
             "lambda r: upper(r[1]) || lower(r[2:])), '')")
STRIP_SQL = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
DATE_FORMATS_SQL = ("['%d/%m/%Y %H:%M', '%d/%m/%Y %H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%d/%m/%Y', "
                    "'%Y/%m/%d %H:%M', '%d %b %Y %H:%M', '%Y-%m-%dT%H:%M:%SZ']")

# The limits beyond which rows are removed under their own reason.
IN_RANGE_SQL = "(abs(Quantity) < 1e12 AND abs(Quantity) * CAST(UnitPrice AS DOUBLE) < 1e20)"

PREPARED_SQL = f"""{DIRTY_SQL},
c_mode AS (
  SELECT Country AS m FROM dirty WHERE Country IS NOT NULL
  GROUP BY Country ORDER BY count(*) DESC, Country LIMIT 1),
c_filled AS (
  SELECT InvoiceNo, StockCode, coalesce(Description, 'Unknown Product') AS Description,
    coalesce(Quantity, '0') AS Quantity, InvoiceDate, coalesce(UnitPrice, '0') AS UnitPrice,
    coalesce(CustomerID, 'Unknown') AS CustomerID,
    coalesce(Country, (SELECT m FROM c_mode), 'Unknown') AS Country
  FROM dirty),
prepared AS (
  SELECT InvoiceNo, StockCode, Description,
    coalesce(try_cast(Quantity AS DOUBLE), 0.0) AS Quantity,
    try_strptime(InvoiceDate, {DATE_FORMATS_SQL}) AS InvoiceDate,
    coalesce(try_cast(UnitPrice AS DECIMAL(22,6)), 0) AS UnitPrice,
    CustomerID, Country
  FROM c_filled)"""

VALID_SQL = f"""{PREPARED_SQL},
valid AS (
  SELECT InvoiceNo, StockCode, {STRIP_SQL.format(x='Description')} AS Description,
    Quantity, InvoiceDate, UnitPrice, CustomerID,
    {TITLE_SQL.format(x=STRIP_SQL.format(x='Country'))} AS Country
  FROM prepared
  WHERE InvoiceDate IS NOT NULL AND UnitPrice > 0 AND Quantity <> 0 AND {IN_RANGE_SQL})"""

CLEANED_SQL = f"""{VALID_SQL},
c_q99 AS (SELECT quantile_cont(Quantity, 0.99) AS q99q, quantile_cont(CAST(UnitPrice AS DOUBLE), 0.99) AS q99p FROM valid),
c_dedup AS (SELECT DISTINCT * FROM valid),
{derive_sql('c_dedup', 'c_der')},
c_flag AS (
  SELECT x.*, x.InvoiceNo || '_' || x.StockCode AS TransactionRef,
    CAST(1.0 AS DOUBLE)
      * (CASE WHEN x.Quantity > q.q99q * 3 THEN CAST(0.7 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END)
      * (CASE WHEN CAST(x.UnitPrice AS DOUBLE) > q.q99p * 3 THEN CAST(0.7 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END)
      AS DataQualityScore,
    CASE WHEN CAST(x.UnitPrice AS DOUBLE) > q.q99p * 3 THEN 'Extreme price'
         WHEN x.Quantity > q.q99q * 3 THEN 'Extreme quantity' END AS QualityFlag
  FROM c_der x CROSS JOIN c_q99 q),
cleaned AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY InvoiceNo, date_trunc('minute', InvoiceDate)) > 3
                 THEN true END AS NeedsReview
  FROM c_flag)"""

BASES = {
    "none": "",
    "dirty": DIRTY_SQL,
    "prepared": PREPARED_SQL,
    "valid": VALID_SQL,
    "cleaned": CLEANED_SQL,
    "ctx": f"{CLEANED_SQL},\ntx AS (SELECT * FROM cleaned)",
    "sales": SALES_SQL,
    "tx": f"{SALES_SQL},\n{derive_sql('sales', 'tx')}",
    "keyed": f"{SALES_KEYED_SQL},\n{derive_sql('sales', 'tx')}",
}


def sql(base: str, body: str, ctes: str = "") -> str:
    """``WITH <base>, <ctes> <body>``."""
    parts = [p for p in (BASES[base], ctes.strip().rstrip(",")) if p]
    head = ("WITH " + ",\n".join(parts) + "\n") if parts else ""
    return head + body.strip()


def keyed_sql(ctes: str) -> str:
    """The CTEs of a base over the ``dirty`` table with a ``Region`` column, every step per region."""
    pairs = [
        ("n.n_name END AS Country", "n.n_name END AS Country, r.r_name AS Region"),
        ("JOIN part p ON l.l_partkey = p.p_partkey),\ndirty AS", "JOIN part p ON l.l_partkey = p.p_partkey JOIN region r ON n.n_regionkey = r.r_regionkey),\ndirty AS"),
        ("CustomerID, Country FROM dirty_base", "CustomerID, Country, Region FROM dirty_base"),
        ("""  SELECT Country AS m FROM dirty WHERE Country IS NOT NULL
  GROUP BY Country ORDER BY count(*) DESC, Country LIMIT 1),""",
         """  SELECT Region, Country AS m FROM dirty WHERE Country IS NOT NULL
  GROUP BY Region, Country QUALIFY row_number() OVER (PARTITION BY Region ORDER BY count(*) DESC, Country) = 1),"""),
        ("coalesce(Country, (SELECT m FROM c_mode), 'Unknown') AS Country\n  FROM dirty)",
         "coalesce(Country, m, 'Unknown') AS Country, Region\n  FROM dirty LEFT JOIN c_mode USING (Region))"),
        ("CustomerID, Country\n  FROM c_filled", "CustomerID, Country, Region\n  FROM c_filled"),
        ("AS Country\n  FROM prepared", "AS Country, Region\n  FROM prepared"),
        ("c_q99 AS (SELECT quantile_cont", "c_q99 AS (SELECT Region, quantile_cont"), ("AS q99p FROM valid)", "AS q99p FROM valid GROUP BY Region)"),
        ("FROM c_der x CROSS JOIN c_q99 q", "FROM c_der x JOIN c_q99 q USING (Region)"),
        ("PARTITION BY InvoiceNo,", "PARTITION BY Region, InvoiceNo,"),
    ]
    for a, b in pairs:
        ctes = ctes.replace(a, b)
    return ctes
