"""Registered queries: KPIs (K), windows (W), top-k (T), distributions (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.catalog import register
from tillroll.catalog.bases import cleaned, keyed, sql, tx
from tillroll.operators import distribution as D
from tillroll.operators import kpi as K
from tillroll.operators import topk as T
from tillroll.operators import windows as W
from tillroll.functions.columns import ratio
from tillroll.plans import sketches as SK
from tillroll.plans.prefix import PageIndex
from tillroll.session import store
from tillroll.sources.fixtures import dirty
from tillroll.sources.tables import table

MONEY = "CAST(round({x}, 2) AS DOUBLE)"
WD_SQL = """wd AS (SELECT * FROM (VALUES ('Monday', 1), ('Tuesday', 2), ('Wednesday', 3), ('Thursday', 4),
  ('Friday', 5), ('Saturday', 6), ('Sunday', 7)) t(weekday, day_index))"""

KNOWN = "CustomerID IS NOT NULL AND CustomerID <> 'Unknown'"
CS_SQL = f"""cs AS (
  SELECT CustomerID, sum(Revenue) AS spent, CAST(round(sum(Revenue), 2) AS DOUBLE) AS total_spent,
    count(DISTINCT InvoiceNo) AS transaction_count, CAST(sum(Quantity) AS BIGINT) AS total_items,
    round(coalesce(CAST(sum(Revenue) AS DOUBLE) / nullif(count(DISTINCT InvoiceNo), 0), 0), 4) AS avg_transaction_value,
    max(InvoiceDate) AS last_date
  FROM tx WHERE {KNOWN} GROUP BY CustomerID)"""
PP_SQL = """pp AS (
  SELECT StockCode, Description, sum(Revenue) AS rev, CAST(round(sum(Revenue), 2) AS DOUBLE) AS total_revenue,
    CAST(sum(Quantity) AS BIGINT) AS total_quantity, count(DISTINCT InvoiceNo) AS transaction_count,
    round(coalesce(CAST(sum(Revenue) AS DOUBLE) / nullif(sum(Quantity), 0), 0), 4) AS avg_price
  FROM tx WHERE StockCode IS NOT NULL AND Description IS NOT NULL GROUP BY StockCode, Description)"""
CP_SQL = """cp AS (
  SELECT Country, sum(Revenue) AS rev, CAST(round(sum(Revenue), 2) AS DOUBLE) AS total_revenue,
    count(DISTINCT InvoiceNo) AS transaction_count, count(DISTINCT CustomerID) AS customer_count,
    CAST(sum(Quantity) AS BIGINT) AS total_quantity
  FROM tx WHERE Country IS NOT NULL GROUP BY Country)"""


def summary_sql(base: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return sql(base, f"""
SELECT {sel}CAST(round(sum(Revenue), 2) AS DOUBLE) AS total_revenue,
  count(DISTINCT InvoiceNo) AS total_transactions, count(DISTINCT StockCode) AS total_products,
  count(DISTINCT CustomerID) AS total_customers, CAST(sum(Quantity) AS BIGINT) AS total_items_sold,
  round(coalesce(CAST(sum(Revenue) AS DOUBLE) / nullif(count(DISTINCT InvoiceNo), 0), 0), 4) AS avg_transaction_value,
  round(coalesce(sum(Quantity) / nullif(count(DISTINCT InvoiceNo), 0), 0), 4) AS avg_items_per_transaction,
  strftime(min(InvoiceDate), '%Y-%m-%d') AS date_start, strftime(max(InvoiceDate), '%Y-%m-%d') AS date_end,
  coalesce(datesub('day', min(InvoiceDate), max(InvoiceDate)), 0) AS days
FROM tx {grp}""")


# ----------------------------------------------------------------------------------- K
register("kpi_summary", lambda s, d: K.summary(tx(s, d)), summary_sql("tx"))
register("kpi_summary_by_region", lambda s, d: K.summary(keyed(s, d), ["Region"]), summary_sql("keyed", "Region"))
register("kpi_summary_clean", lambda s, d: K.summary(cleaned(s, d)), summary_sql("ctx"))

register("kpi_monthly_revenue", lambda s, d: K.monthly_revenue(tx(s, d)), sql("tx", """
SELECT printf('%d-%02d', Year, Month) AS period, CAST(round(sum(Revenue), 2) AS DOUBLE) AS revenue
FROM tx GROUP BY Year, Month"""))
register("kpi_monthly_revenue_by_region", lambda s, d: K.monthly_revenue(keyed(s, d), ["Region"]), sql("keyed", """
SELECT Region, printf('%d-%02d', Year, Month) AS period, CAST(round(sum(Revenue), 2) AS DOUBLE) AS revenue
FROM tx GROUP BY Region, Year, Month"""))

register("kpi_quarterly_revenue", lambda s, d: K.quarterly_revenue(tx(s, d)), sql("tx", """
SELECT printf('Q%d %d', Quarter, Year) AS period, CAST(round(sum(Revenue), 2) AS DOUBLE) AS revenue
FROM tx GROUP BY Year, Quarter"""))

register("kpi_weekday_revenue", lambda s, d: K.weekday_revenue(tx(s, d)), sql("tx", """
SELECT wd.weekday, CAST(wd.day_index AS BIGINT) AS day_index, CAST(round(coalesce(a.rev, 0), 2) AS DOUBLE) AS revenue
FROM wd LEFT JOIN (SELECT Weekday AS weekday, sum(Revenue) AS rev FROM tx GROUP BY Weekday) a USING (weekday)""",
                                                                                ctes=WD_SQL))
register("kpi_weekday_revenue_by_segment", lambda s, d: K.weekday_revenue(keyed(s, d), ["Segment"]), sql("keyed", """
SELECT g.Segment, wd.weekday, CAST(wd.day_index AS BIGINT) AS day_index, CAST(round(coalesce(a.rev, 0), 2) AS DOUBLE) AS revenue
FROM (SELECT DISTINCT Segment FROM tx WHERE Segment IS NOT NULL) g CROSS JOIN wd
LEFT JOIN (SELECT Segment, Weekday AS weekday, sum(Revenue) AS rev FROM tx GROUP BY Segment, Weekday) a
  ON a.Segment = g.Segment AND a.weekday = wd.weekday""", ctes=WD_SQL))

register("kpi_revenue_distribution", lambda s, d: K.revenue_distribution(tx(s, d)), sql("tx", """
SELECT CAST(round(min(Revenue), 2) AS DOUBLE) AS min, CAST(round(max(Revenue), 2) AS DOUBLE) AS max,
  round(CAST(sum(Revenue) AS DOUBLE) / nullif(count(Revenue), 0), 4) AS mean,
  round(quantile_cont(CAST(Revenue AS DOUBLE), 0.5), 4) AS median,
  round(stddev_samp(CAST(Revenue AS DOUBLE)), 4) AS std,
  round(quantile_cont(CAST(Revenue AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST(Revenue AS DOUBLE), 0.5), 4) AS p50,
  round(quantile_cont(CAST(Revenue AS DOUBLE), 0.75), 4) AS p75, round(quantile_cont(CAST(Revenue AS DOUBLE), 0.9), 4) AS p90
FROM tx"""))

register("kpi_customer_spend", lambda s, d: K.customer_spend(tx(s, d)), sql("tx", """
SELECT CustomerID, total_spent, transaction_count, total_items, avg_transaction_value FROM cs""", ctes=CS_SQL))

SEG_SQL = CS_SQL + """,
e AS (SELECT quantile_cont(total_spent, 0.0) AS e0, quantile_cont(total_spent, 0.25) AS e1,
  quantile_cont(total_spent, 0.5) AS e2, quantile_cont(total_spent, 0.75) AS e3, quantile_cont(total_spent, 1.0) AS e4 FROM cs),
seg AS (
  SELECT CustomerID, total_spent,
    CASE WHEN NOT (e0 < e1 AND e1 < e2 AND e2 < e3 AND e3 < e4) THEN 'Medium'
         WHEN total_spent <= e1 THEN 'Low' WHEN total_spent <= e2 THEN 'Medium'
         WHEN total_spent <= e3 THEN 'High' ELSE 'VIP' END AS segment
  FROM cs CROSS JOIN e)"""
register("kpi_customer_segments", lambda s, d: K.customer_segments(tx(s, d)),
         sql("tx", "SELECT CustomerID, total_spent, segment FROM seg", ctes=SEG_SQL))

register("kpi_segment_distribution", lambda s, d: K.segment_distribution(tx(s, d)), sql("tx", """
SELECT l.segment, CAST(coalesce(n, 0) AS BIGINT) AS customers
FROM (VALUES ('Low'), ('Medium'), ('High'), ('VIP')) l(segment)
LEFT JOIN (SELECT segment, count(*) AS n FROM seg GROUP BY segment) c USING (segment)""", ctes=SEG_SQL))

RFM_SQL = CS_SQL + f""",
ref AS (SELECT max(InvoiceDate) AS r FROM tx WHERE {KNOWN}),
rfm AS (SELECT CustomerID, datesub('day', last_date, (SELECT r FROM ref)) AS recency,
  transaction_count AS frequency, total_spent AS monetary, spent FROM cs)"""
register("kpi_rfm", lambda s, d: K.rfm(tx(s, d)),
         sql("tx", "SELECT CustomerID, recency, frequency, monetary FROM rfm", ctes=RFM_SQL))
register("kpi_rfm_summary", lambda s, d: K.rfm_summary(tx(s, d)), sql("tx", """
SELECT round(CAST(sum(recency) AS DOUBLE) / count(recency), 4) AS avg_recency,
  round(CAST(sum(frequency) AS DOUBLE) / count(frequency), 4) AS avg_frequency,
  round(CAST(sum(spent) AS DOUBLE) / count(spent), 4) AS avg_monetary FROM rfm""", ctes=RFM_SQL))

register("kpi_customer_overview", lambda s, d: K.customer_overview(tx(s, d)), sql("tx", """
SELECT count(*) AS customer_count, count(*) FILTER (WHERE transaction_count > 1) AS active_customers,
  count(*) FILTER (WHERE transaction_count = 1) AS one_time_customers,
  round(CAST(sum(spent) AS DOUBLE) / nullif(count(spent), 0), 4) AS avg_customer_value,
  round(quantile_cont(total_spent, 0.5), 4) AS median_customer_value,
  round(coalesce(count(*) FILTER (WHERE transaction_count = 1) * 100.0 / nullif(count(*), 0), 0), 4) AS one_time_pct
FROM cs""", ctes=CS_SQL))

register("kpi_product_performance", lambda s, d: K.product_performance(tx(s, d)), sql("tx", """
SELECT StockCode, Description, total_revenue, total_quantity, transaction_count, avg_price FROM pp""", ctes=PP_SQL))

register("kpi_product_overview", lambda s, d: K.product_overview(tx(s, d)), sql("tx", """
SELECT count(*) AS total_products, count(DISTINCT StockCode) AS unique_products_sold,
  round(sum(avg_price) / nullif(count(avg_price), 0), 4) AS avg_product_price,
  round(quantile_cont(avg_price, 0.5), 4) AS median_product_price,
  round(min(avg_price), 4) AS min_price, round(max(avg_price), 4) AS max_price FROM pp""", ctes=PP_SQL))

register("kpi_daily", lambda s, d: K.daily(tx(s, d)), sql("tx", """
SELECT Date, CAST(round(sum(Revenue), 2) AS DOUBLE) AS daily_revenue, count(DISTINCT InvoiceNo) AS daily_transactions,
  count(DISTINCT CustomerID) AS daily_customers, CAST(sum(Quantity) AS BIGINT) AS daily_items
FROM tx GROUP BY Date"""))

register("kpi_weekday_pattern", lambda s, d: K.weekday_pattern(tx(s, d)), sql("tx", """
SELECT wd.weekday, CAST(wd.day_index AS BIGINT) AS day_index, CAST(round(a.s, 2) AS DOUBLE) AS total_revenue,
  a.n AS transaction_rows, round(CAST(a.s AS DOUBLE) / a.n, 4) AS mean_revenue
FROM wd LEFT JOIN (SELECT Weekday AS weekday, sum(Revenue) AS s, count(*) AS n FROM tx GROUP BY Weekday) a USING (weekday)""",
                                                                                ctes=WD_SQL))

register("kpi_seasonality", lambda s, d: K.seasonality(tx(s, d)), sql("tx", """
SELECT (SELECT weekday FROM x ORDER BY m DESC, day_index LIMIT 1) AS best_day,
  (SELECT weekday FROM x ORDER BY m ASC, day_index LIMIT 1) AS worst_day,
  round(CASE WHEN avg(m) > 0 THEN (max(m) - min(m)) / avg(m) * 100 ELSE 0.0 END, 4) AS weekly_variation
FROM x""", ctes=WD_SQL + """,
x AS (SELECT a.weekday, a.m, wd.day_index FROM
  (SELECT Weekday AS weekday, CAST(sum(Revenue) AS DOUBLE) / count(Revenue) AS m FROM tx GROUP BY Weekday) a
  JOIN wd USING (weekday) WHERE a.m IS NOT NULL)"""))

register("kpi_country", lambda s, d: K.country_performance(tx(s, d)), sql("tx", """
SELECT Country, total_revenue, transaction_count, customer_count, total_quantity FROM cp""", ctes=CP_SQL))

register("kpi_geo_overview", lambda s, d: K.geo_overview(tx(s, d)), sql("tx", """
SELECT count(*) AS countries_covered,
  round(CASE WHEN count(*) > 1 THEN (1 - CAST(max(rev) AS DOUBLE) / CAST(sum(rev) AS DOUBLE)) * 100 ELSE 0.0 END, 4)
    AS international_percentage
FROM cp""", ctes=CP_SQL))

register("kpi_month_profile", lambda s, d: K.month_profile(tx(s, d)), sql("tx", """
SELECT strftime(date_trunc('month', InvoiceDate), '%Y-%m') AS month, CAST(round(sum(Revenue), 2) AS DOUBLE) AS total_revenue,
  count(*) AS transaction_count, round(CAST(sum(Revenue) AS DOUBLE) / count(Revenue), 4) AS avg_transaction
FROM tx GROUP BY date_trunc('month', InvoiceDate)"""))

register("kpi_sales_vs_returns", lambda s, d: K.sales_vs_returns(tx(s, d)), sql("tx", """
SELECT CAST(round(sum(SalesRevenue), 2) AS DOUBLE) AS sales_value, CAST(round(sum(ReturnsValue), 2) AS DOUBLE) AS returns_value,
  count(*) FILTER (WHERE NOT IsReturn) AS sales_rows, count(*) FILTER (WHERE IsReturn) AS return_rows,
  round(coalesce(count(*) FILTER (WHERE IsReturn) * 100.0 / nullif(count(*), 0), 0), 4) AS return_row_pct
FROM tx"""))

# ----------------------------------------------------------------------------------- W
register("win_moving_avg", lambda s, d: W.moving_average(tx(s, d)), sql("tx", """
SELECT Date, CAST(round(rev, 2) AS DOUBLE) AS daily_revenue,
  round(CASE WHEN count(rev) OVER w7 = 7 THEN CAST(sum(rev) OVER w7 AS DOUBLE) / 7 ELSE 0.0 END, 4) AS revenue_7d_ma,
  round(CASE WHEN count(rev) OVER w30 = 30 THEN CAST(sum(rev) OVER w30 AS DOUBLE) / 30 ELSE 0.0 END, 4) AS revenue_30d_ma
FROM (SELECT Date, sum(Revenue) AS rev FROM tx GROUP BY Date) d
WINDOW w7 AS (ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (ORDER BY Date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))

MOM_SQL = """m AS (SELECT Year, Month, round(sum(Revenue), 2) AS rev FROM tx GROUP BY Year, Month),
mg AS (SELECT *, lag(rev) OVER (ORDER BY Year, Month) AS prev, row_number() OVER (ORDER BY Year, Month) AS k,
  count(*) OVER () AS n FROM m),
mom AS (
  SELECT printf('%d-%02d', Year, Month) AS period, CAST(rev AS DOUBLE) AS revenue, CAST(prev AS DOUBLE) AS prev_revenue,
    CASE WHEN prev > 0 THEN round(CAST(rev - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100, 2) END AS revenue_mom,
    CASE WHEN prev IS NULL THEN NULL WHEN NOT (prev > 0) THEN 'stable' WHEN rev > prev THEN 'increasing'
         ELSE 'decreasing' END AS revenue_trend,
    (k = n AND n >= 2) AS is_latest
  FROM mg)"""
register("win_mom_growth", lambda s, d: W.monthly_growth(tx(s, d)), sql("tx", "SELECT * FROM mom", ctes=MOM_SQL))

PARETO_SQL = PP_SQL + """,
par AS (
  SELECT StockCode, Description, row_number() OVER o AS rank, total_revenue,
    CAST(round(sum(rev) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS DOUBLE) AS cumulative_revenue,
    round(CAST(sum(rev) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
          / CAST(sum(rev) OVER () AS DOUBLE) * 100, 4) AS cumulative_pct, rev
  FROM pp WINDOW o AS (ORDER BY rev DESC, StockCode, Description))"""
register("win_pareto", lambda s, d: W.pareto(tx(s, d)), sql("tx", """
SELECT StockCode, Description, rank, total_revenue, cumulative_revenue, cumulative_pct FROM par""", ctes=PARETO_SQL))
register("win_pareto_top20", lambda s, d: W.pareto_top_share(tx(s, d)), sql("tx", """
SELECT count(*) AS products, CAST(floor(count(*) * 0.2) AS BIGINT) AS top_count,
  CAST(round(coalesce(sum(rev) FILTER (WHERE rank <= floor((SELECT count(*) FROM par) * 0.2)), 0), 2) AS DOUBLE) AS top_revenue,
  CAST(round(sum(rev), 2) AS DOUBLE) AS total_revenue,
  round(CAST(coalesce(sum(rev) FILTER (WHERE rank <= floor((SELECT count(*) FROM par) * 0.2)), 0) AS DOUBLE)
        / CAST(sum(rev) AS DOUBLE) * 100, 4) AS concentration_pct
FROM par""", ctes=PARETO_SQL))

register("win_latest_per_key",
         lambda s, d: W.latest_per_key(table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"),
                                       "o_custkey", "o_orderdate", "o_orderkey"),
         sql("none", """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t
WHERE rn = 1"""))

register("win_history",
         lambda s, d: W.history(table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"),
                                "o_custkey", "o_orderdate", "o_orderkey"),
         sql("none", """
SELECT o_orderkey, o_custkey, o_orderdate,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS seq
FROM orders WHERE o_custkey IS NOT NULL"""))

# ----------------------------------------------------------------------------------- T
register("top_customers", lambda s, d: T.top_customers(tx(s, d)), sql("tx", """
SELECT row_number() OVER (ORDER BY total_spent DESC, CustomerID) AS rank, CustomerID, total_spent,
  transaction_count AS transactions, avg_transaction_value AS avg_value
FROM cs ORDER BY total_spent DESC, CustomerID LIMIT 10""", ctes=CS_SQL))

register("top_customers_by_region", lambda s, d: T.top_customers(keyed(s, d), 3, ["Region"]), sql("keyed", """
SELECT Region, rank, CustomerID, total_spent, transactions, avg_value FROM (
  SELECT Region, CAST(row_number() OVER (PARTITION BY Region ORDER BY round(sum(Revenue), 2) DESC, CustomerID) AS BIGINT) AS rank,
    CustomerID, CAST(round(sum(Revenue), 2) AS DOUBLE) AS total_spent, count(DISTINCT InvoiceNo) AS transactions,
    round(coalesce(CAST(sum(Revenue) AS DOUBLE) / nullif(count(DISTINCT InvoiceNo), 0), 0), 4) AS avg_value
  FROM tx WHERE CustomerID IS NOT NULL AND CustomerID <> 'Unknown' GROUP BY Region, CustomerID) t
WHERE rank <= 3"""))

register("top_products", lambda s, d: T.top_products(tx(s, d)), sql("tx", """
SELECT row_number() OVER (ORDER BY total_revenue DESC, StockCode, Description) AS rank, StockCode, Description,
  total_revenue, total_quantity, transaction_count, avg_price
FROM pp ORDER BY total_revenue DESC, StockCode, Description LIMIT 10""", ctes=PP_SQL))

register("top_countries", lambda s, d: T.top_countries(tx(s, d)), sql("tx", """
SELECT row_number() OVER (ORDER BY total_revenue DESC, Country) AS rank, Country, total_revenue,
  transaction_count AS transactions, customer_count AS customers
FROM cp ORDER BY total_revenue DESC, Country LIMIT 5""", ctes=CP_SQL))

register("top_performers", lambda s, d: T.top_performers(tx(s, d)), sql("tx", """
SELECT 'products' AS kind, rank, StockCode AS id FROM (
  SELECT row_number() OVER (ORDER BY total_revenue DESC, StockCode, Description) AS rank, StockCode FROM pp) t WHERE rank <= 5
UNION ALL SELECT 'customers', rank, CustomerID FROM (
  SELECT row_number() OVER (ORDER BY total_spent DESC, CustomerID) AS rank, CustomerID FROM cs) t WHERE rank <= 5
UNION ALL SELECT 'countries', rank, Country FROM (
  SELECT row_number() OVER (ORDER BY total_revenue DESC, Country) AS rank, Country FROM cp) t WHERE rank <= 3""",
                                                                        ctes=",\n".join([CS_SQL, PP_SQL, CP_SQL])))

register("page_datasets",
         lambda s, d: T.page(table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"),
                             [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], skip=20, limit=100),
         sql("none", """
SELECT o_orderkey, o_custkey, o_orderdate,
  row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) + 20 AS position,
  (SELECT count(*) FROM orders) AS total
FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 20) t"""))



def _pages(s, d):
    """A deep page by its offset, and the page after the last row of it by its key."""
    index = PageIndex(table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), {"o_orderdate": True, "o_orderkey": True})
    deep = index.page(1200, 50)
    last = deep.orderBy(F.desc("position")).select("o_orderdate", "o_orderkey").first()  # one row
    after = index.after(tuple(last), 25)
    cols = ["o_orderkey", "o_custkey", "o_orderdate"]
    return (deep.select(F.lit("offset").alias("by"), *cols, "position", F.lit(index.total()).cast("bigint").alias("total"))
            .unionByName(after.select(F.lit("key").alias("by"), *cols, F.lit(None).cast("bigint").alias("position"),
                                      F.lit(index.total()).cast("bigint").alias("total"))))


register("page_deep", _pages, sql("none", """
SELECT CASE WHEN position <= 1250 THEN 'offset' ELSE 'key' END AS by, o_orderkey, o_custkey, o_orderdate,
  CASE WHEN position <= 1250 THEN position END AS position, total
FROM (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS position,
  count(*) OVER () AS total FROM orders) t WHERE position > 1200 AND position <= 1275"""))

register("freq_head", lambda s, d: T.frequency_head(tx(s, d)), sql("tx", """
SELECT transaction_count, count(*) AS customers FROM cs GROUP BY transaction_count
ORDER BY transaction_count LIMIT 20""", ctes=CS_SQL))

# ----------------------------------------------------------------------------------- D
register("profile_columns", lambda s, d: D.profile_columns(dirty(s, d)), sql("dirty", """
SELECT CAST(p.position AS BIGINT) AS position, p."column", 'string' AS dtype, u.n_unique
FROM (VALUES (0, 'InvoiceNo'), (1, 'StockCode'), (2, 'Description'), (3, 'Quantity'), (4, 'InvoiceDate'),
  (5, 'UnitPrice'), (6, 'CustomerID'), (7, 'Country')) p(position, "column")
JOIN (
  SELECT 'InvoiceNo' AS "column", count(DISTINCT InvoiceNo) AS n_unique FROM dirty
  UNION ALL SELECT 'StockCode', count(DISTINCT StockCode) FROM dirty
  UNION ALL SELECT 'Description', count(DISTINCT Description) FROM dirty
  UNION ALL SELECT 'Quantity', count(DISTINCT Quantity) FROM dirty
  UNION ALL SELECT 'InvoiceDate', count(DISTINCT InvoiceDate) FROM dirty
  UNION ALL SELECT 'UnitPrice', count(DISTINCT UnitPrice) FROM dirty
  UNION ALL SELECT 'CustomerID', count(DISTINCT CustomerID) FROM dirty
  UNION ALL SELECT 'Country', count(DISTINCT Country) FROM dirty) u USING ("column")"""))

register("profile_unique", lambda s, d: D.profile_unique(tx(s, d)), sql("tx", """
SELECT count(DISTINCT CustomerID) AS customers, count(DISTINCT StockCode) AS products,
  count(DISTINCT InvoiceNo) AS invoices, count(DISTINCT Country) AS countries FROM tx"""))


def _describe_sql(col: str) -> str:
    v = f"CAST({col} AS DOUBLE)"
    return f"""SELECT '{col}' AS "column", count({col}) AS count, round(CAST(sum({col}) AS DOUBLE) / count({col}), 4) AS mean,
  round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min, round(quantile_cont({v}, 0.25), 4) AS p25,
  round(quantile_cont({v}, 0.5), 4) AS p50, round(quantile_cont({v}, 0.75), 4) AS p75, round(max({v}), 4) AS max FROM tx"""


DESCRIBE_COLS = ["Quantity", "UnitPrice", "NetRevenue"]
register("describe_numeric", lambda s, d: D.describe_numeric(tx(s, d), DESCRIBE_COLS),
         sql("tx", "\nUNION ALL\n".join(_describe_sql(c) for c in DESCRIBE_COLS)))


def _trim_summary(s, d):
    t = store(tx(s, d).select(*DESCRIBE_COLS), "trim-rows")  # read twice for each column
    parts = []
    for c in DESCRIBE_COLS:
        kept = D.trim_p99(t, c)
        parts.append(kept.groupBy().agg(F.lit(c).alias("column"), ratio(F.max("q99")).alias("q99"),
                                        F.count(F.lit(1)).alias("kept_rows"),
                                        F.sum(F.col(c)).cast("double").alias("kept_sum")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _trim_sql(col: str) -> str:
    return f"""SELECT '{col}' AS "column", round(max(q), 4) AS q99, count(*) AS kept_rows, CAST(sum({col}) AS DOUBLE) AS kept_sum
FROM tx, (SELECT quantile_cont(CAST({col} AS DOUBLE), 0.99) AS q FROM tx) qq
WHERE CAST({col} AS DOUBLE) >= 1 AND CAST({col} AS DOUBLE) <= q"""


register("trim_p99", _trim_summary, sql("tx", "\nUNION ALL\n".join(_trim_sql(c) for c in DESCRIBE_COLS)))


def _hist(s, d):
    t = store(tx(s, d).select("CustomerID", "Revenue", "NetRevenue", "Quantity", "InvoiceNo", "InvoiceDate"), "trim-rows")
    a = D.histogram(D.trim_p99(t, "NetRevenue"), "NetRevenue")
    b = D.histogram(D.trim_p99(t, "Quantity"), "Quantity")
    spend = K.customer_spend(t)
    c = D.histogram(D.trim_p99(spend, "total_spent", lower=None, upper_inclusive=False), "total_spent")
    return a.unionByName(b).unionByName(c)


def _hist_sql(col: str, src: str, cond: str) -> str:
    return f"""SELECT '{col}' AS "column", CAST(b.bin AS BIGINT) AS bin,
  round(lo + (hi - lo) / 50 * b.bin, 4) AS lower, round(lo + (hi - lo) / 50 * (b.bin + 1), 4) AS upper,
  CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM h_{col}) r
CROSS JOIN range(50) b(bin)
LEFT JOIN (SELECT CAST(least(floor((x - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS bin, count(*) AS n
           FROM h_{col}, (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                                 CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM h_{col}) rr
           GROUP BY 1) c ON c.bin = b.bin"""


HIST_CTES = CS_SQL + """,
h_NetRevenue AS (SELECT CAST(NetRevenue AS DOUBLE) AS x FROM tx, (SELECT quantile_cont(CAST(NetRevenue AS DOUBLE), 0.99) AS q FROM tx) qq
  WHERE CAST(NetRevenue AS DOUBLE) >= 1 AND CAST(NetRevenue AS DOUBLE) <= q),
h_Quantity AS (SELECT Quantity AS x FROM tx, (SELECT quantile_cont(Quantity, 0.99) AS q FROM tx) qq
  WHERE Quantity >= 1 AND Quantity <= q),
h_total_spent AS (SELECT total_spent AS x FROM cs, (SELECT quantile_cont(total_spent, 0.99) AS q FROM cs) qq
  WHERE total_spent < q)"""
register("histogram", _hist, sql("tx", "\nUNION ALL\n".join(_hist_sql(c, "", "") for c in ["NetRevenue", "Quantity", "total_spent"]),
                                 ctes=HIST_CTES))

BOX = [("Quantity", -50, 50, True), ("UnitPrice", None, 50_000, False), ("NetRevenue", 1, 200_000, True)]


def _box(s, d):
    t = tx(s, d)
    parts = [D.box_stats(t, c, lo, hi, inc) for c, lo, hi, inc in BOX]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _box_sql(col, lo, hi, inc) -> str:
    v = f"CAST({col} AS DOUBLE)"
    cond = [f"{v} IS NOT NULL"]
    if lo is not None:
        cond.append(f"{v} >= {lo}")
    if hi is not None:
        cond.append(f"{v} {'<=' if inc else '<'} {hi}")
    where = " AND ".join(cond)
    return f"""SELECT '{col}' AS "column", count(x) AS n, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median,
  round(any_value(q3), 4) AS q3, round(any_value(q3) - any_value(q1), 4) AS iqr,
  round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
  round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS q2, quantile_cont({v}, 0.75) AS q3
      FROM tx WHERE {where}) q
LEFT JOIN (SELECT {v} AS x FROM tx WHERE {where}) d ON true"""


register("box_stats", _box, sql("tx", "\nUNION ALL\n".join(_box_sql(*b) for b in BOX)))

register("freq_distribution", lambda s, d: D.freq_distribution(tx(s, d)), sql("tx", """
SELECT transaction_count, count(*) AS customers FROM cs GROUP BY transaction_count""", ctes=CS_SQL))


# Mergeable approximate quantiles: the sketches of five uploads (regions) are stored and merged; each returned value is then
# held against the exact ranks of the rows.
SKETCHED, SKETCH_PROBS = ["NetRevenue", "Quantity", "UnitPrice"], [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _sketches(s, d):
    rows = keyed(s, d)
    stored = store(SK.quantile_sketches(rows, SKETCHED, ["Region"]), "upload-sketches")
    found = SK.sketch_quantiles(SK.merge_sketches(stored), SKETCH_PROBS)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in SKETCHED]))
    # One row per column and probability, so the broadcast is bounded.
    ranks = (rows.select(cells).join(F.broadcast(found), "column").groupBy("column", "n", "probability")
             .agg(F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto")))
    share = F.col("probability") * F.col("n")
    slack = F.col("n") * SK.RANK_ERROR + 1
    return ranks.select("column", F.col("n").cast("bigint").alias("n"), "probability",
                        ((F.col("below") <= share + slack) & (F.col("upto") >= share - slack)).alias("within_bound"))


register("sketch_quantiles", _sketches, sql("keyed", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, CAST({p} AS DOUBLE) AS probability, true AS within_bound FROM tx"""
    for c in SKETCHED for p in SKETCH_PROBS)))
