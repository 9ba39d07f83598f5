"""Registered queries: joins / history (J), formats (F), health, insights (I), long metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.catalog import ORACLE, register
from tillroll.catalog.bases import keyed, sql, tx
from tillroll.catalog.q_kpi import CP_SQL, CS_SQL, KNOWN, PP_SQL, WD_SQL
from tillroll.functions.columns import fmt_currency, fmt_label, fmt_number, money
from tillroll.operators import history as H
from tillroll.operators import insights as I
from tillroll.operators import kpi as K
from tillroll.operators import report as R
from tillroll.operators.health import health_scores
from tillroll.plans.metrics import SPEC, long_metrics, metric_count
from tillroll.sources.tables import table

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]

# ----------------------------------------------------------------------------------- J


def _calendar(s, d):
    t = tx(s, d)
    agg = t.groupBy(F.col("MonthName").alias("month")).agg(F.sum("Revenue").alias("_rev"))
    dim = s.createDataFrame([(m, i + 1) for i, m in enumerate(MONTHS)], "month string, month_index int")
    out = K.reindex(agg, dim, "month")
    return out.select("month", F.col("month_index").cast("bigint").alias("month_index"),
                      money(F.coalesce(F.col("_rev"), F.lit(0))).alias("revenue"))


MONTHS_SQL = ", ".join(f"('{m}', {i + 1})" for i, m in enumerate(MONTHS))
register("join_calendar_reindex", _calendar, sql("tx", f"""
SELECT l.month, CAST(l.month_index AS BIGINT) AS month_index, CAST(round(coalesce(a.rev, 0), 2) AS DOUBLE) AS revenue
FROM (VALUES {MONTHS_SQL}) l(month, month_index)
LEFT JOIN (SELECT MonthName AS month, sum(Revenue) AS rev FROM tx GROUP BY MonthName) a USING (month)"""))


def _exists(s, d):
    cust = table(s, d, "customer", "c_custkey")
    orders = table(s, d, "orders", "o_custkey", "o_orderpriority")
    return H.exists_flags(cust, "c_custkey", {
        "has_orders": (orders, "o_custkey"),
        "has_urgent_orders": (orders.where(F.col("o_orderpriority") == "1-URGENT"), "o_custkey")})


register("join_exists_flags", _exists, sql("none", """
SELECT c_custkey,
  coalesce(c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL), false) AS has_orders,
  coalesce(c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT'), false)
    AS has_urgent_orders
FROM customer"""))

register("join_dataset_info",
         lambda s, d: H.with_parent(table(s, d, "orders", "o_orderkey", "o_custkey", "o_totalprice"),
                                    table(s, d, "customer", "c_custkey", "c_name", "c_mktsegment"),
                                    "o_custkey", "c_custkey").drop("c_custkey"),
         sql("none", """
SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"""))


def _cascade(s, d):
    cust = table(s, d, "customer", "c_custkey", "c_mktsegment")
    orders = table(s, d, "orders", "o_orderkey", "o_custkey")
    items = table(s, d, "lineitem", "l_orderkey", "l_linenumber")
    gone = cust.where(F.col("c_mktsegment") == "AUTOMOBILE").select("c_custkey")
    first = H.delete_cascade({"customer": (cust, "c_custkey"), "orders": (orders, "o_custkey")}, gone, "c_custkey")
    gone_orders = orders.join(gone, orders.o_custkey == gone.c_custkey, "left_semi").select("o_orderkey")
    second = H.delete_cascade({"lineitem": (items, "l_orderkey")}, gone_orders, "o_orderkey")
    parts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows_after"))
             for name, df in {**first, **second}.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


register("delete_cascade", _cascade, sql("none", """
SELECT 'customer' AS "table", count(*) AS rows_after FROM customer WHERE c_custkey NOT IN
  (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN
  (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN
  (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE'))"""))

register("lookup_by_id", lambda s, d: H.lookup(table(s, d, "customer"), "c_custkey", 42),
         sql("none", "SELECT * FROM customer WHERE c_custkey = 42"))


def _cached(s, d):
    t = keyed(s, d)
    keys = t.select("Country").distinct()
    stored = K.country_performance(t.where(F.col("Region") == "EUROPE")).select("Country", "total_revenue")
    return H.cached_or_generate(keys, stored, ["Country"],
                                lambda missing: K.country_performance(t.join(missing, "Country", "left_semi"))
                                .select("Country", "total_revenue"))


register("cached_or_generate", _cached, sql("keyed", """
SELECT Country, CAST(round(sum(Revenue), 2) AS DOUBLE) AS total_revenue,
  CASE WHEN any_value(Region) = 'EUROPE' THEN 'stored' ELSE 'generated' END AS source
FROM tx GROUP BY Country"""))

# ----------------------------------------------------------------------------------- F
register("fmt_currency",
         lambda s, d: K.product_performance(tx(s, d)).select("StockCode", "Description",
                                                               fmt_currency("total_revenue").alias("revenue_text")),
         sql("tx", "SELECT StockCode, Description, '$' || format('{:,.2f}', coalesce(total_revenue, 0.0)) AS revenue_text FROM pp",
             ctes=PP_SQL))

register("fmt_number",
         lambda s, d: K.customer_spend(tx(s, d)).select("CustomerID", fmt_number("total_items").alias("items_text"),
                                                        fmt_number("avg_transaction_value").alias("avg_text")),
         sql("tx", """
SELECT CustomerID, format('{:,}', total_items) AS items_text, format('{:,}', CAST(trunc(avg_transaction_value) AS BIGINT)) AS avg_text
FROM cs""", ctes=CS_SQL))

register("fmt_label",
         lambda s, d: K.product_performance(tx(s, d)).select("StockCode", fmt_label(F.col("Description"), 12).alias("label")),
         sql("tx", """
SELECT StockCode, CASE WHEN length(Description) > 12 THEN substr(Description, 1, 12) || '...' ELSE Description END AS label
FROM pp""", ctes=PP_SQL))

register("percentile_rows",
         lambda s, d: R.percentile_rows(K.revenue_distribution(tx(s, d)),
                                        {"25th": "p25", "50th": "p50", "75th": "p75", "90th": "p90"}),
         sql("tx", "\nUNION ALL\n".join(
             f"SELECT '{label}' AS percentile, round(quantile_cont(CAST(Revenue AS DOUBLE), {p}), 4) AS value FROM tx"
             for label, p in [("25th", 0.25), ("50th", 0.5), ("75th", 0.75), ("90th", 0.9)])))

register("report_top_customers", lambda s, d: R.top_customers_table(tx(s, d)), sql("tx", """
SELECT row_number() OVER (ORDER BY total_spent DESC, CustomerID) AS rank, substr(CustomerID, 1, 8) || '...' AS Customer,
  '$' || format('{:,.2f}', coalesce(total_spent, 0.0)) AS Spent, transaction_count AS Transactions
FROM cs ORDER BY total_spent DESC, CustomerID LIMIT 5""", ctes=CS_SQL))

register("report_top_products", lambda s, d: R.top_products_table(tx(s, d)), sql("tx", """
SELECT row_number() OVER (ORDER BY total_revenue DESC, StockCode, Description) AS rank,
  CASE WHEN length(coalesce(Description, 'Unknown Product')) > 30 THEN substr(Description, 1, 30) || '...'
       ELSE coalesce(Description, 'Unknown Product') END AS Product,
  total_revenue AS Revenue, total_quantity AS Quantity, transaction_count AS Transactions
FROM pp ORDER BY total_revenue DESC, StockCode, Description LIMIT 10""", ctes=PP_SQL))


# ------------------------------------------------------------------ metrics row / health in SQL
def metrics_ctes(key: str | None = None) -> str:
    k = f"{key}, " if key else ""
    g = f"GROUP BY {key}" if key else ""

    def gk(extra):
        return f"GROUP BY {key}, {extra}" if key else f"GROUP BY {extra}"

    part = f"PARTITION BY {key} " if key else ""

    def on(a, b):
        return f"{a}.{key} = {b}.{key}" if key else "true"

    sel_key = f"m_s.{key}, " if key else ""
    return f"""{WD_SQL},
m_s AS (SELECT {k}CAST(round(sum(Revenue), 2) AS DOUBLE) AS total_revenue, count(DISTINCT InvoiceNo) AS total_transactions,
  count(DISTINCT CustomerID) AS total_customers, count(DISTINCT StockCode) AS total_products,
  strftime(min(InvoiceDate), '%Y-%m-%d') AS date_start, strftime(max(InvoiceDate), '%Y-%m-%d') AS date_end,
  round(round(coalesce(CAST(sum(Revenue) AS DOUBLE) / nullif(count(DISTINCT InvoiceNo), 0), 0), 4), 2) AS avg_transaction_value
  FROM tx {g}),
m_cs AS (SELECT {k}CustomerID, sum(Revenue) AS spent, count(DISTINCT InvoiceNo) AS n FROM tx WHERE {KNOWN} {gk('CustomerID')}),
m_c AS (SELECT {k}count(*) AS customer_count, count(*) FILTER (WHERE n = 1) AS one_time_customers,
  round(round(CAST(sum(spent) AS DOUBLE) / nullif(count(spent), 0), 4), 2) AS avg_customer_value FROM m_cs {g}),
m_pp AS (SELECT {k}StockCode, Description, CAST(round(sum(Revenue), 2) AS DOUBLE) AS total_revenue,
  round(coalesce(CAST(sum(Revenue) AS DOUBLE) / nullif(sum(Quantity), 0), 0), 4) AS avg_price
  FROM tx WHERE StockCode IS NOT NULL AND Description IS NOT NULL {gk('StockCode, Description')}),
m_p AS (SELECT {k}count(*) AS product_rows, round(round(sum(avg_price) / nullif(count(avg_price), 0), 4), 2) AS avg_product_price
  FROM m_pp {g}),
m_t AS (SELECT {k}Description AS top_product_name, total_revenue AS top_product_revenue FROM (
  SELECT *, row_number() OVER ({part}ORDER BY total_revenue DESC, StockCode, Description) AS rn FROM m_pp) t WHERE rn = 1),
m_m AS (SELECT {k}Year, Month, round(sum(Revenue), 2) AS rev FROM tx {gk('Year, Month')}),
m_mg AS (SELECT *, lag(rev) OVER ({part}ORDER BY Year, Month) AS prev, row_number() OVER ({part}ORDER BY Year, Month) AS k_,
  count(*) OVER ({part.strip()}) AS n_ FROM m_m),
m_g AS (SELECT {k}CASE WHEN prev > 0 THEN round(CAST(rev - prev AS DOUBLE) / CAST(prev AS DOUBLE) * 100, 2) END AS revenue_mom,
  CASE WHEN prev IS NULL THEN NULL WHEN NOT (prev > 0) THEN 'stable' WHEN rev > prev THEN 'increasing' ELSE 'decreasing' END
    AS revenue_trend FROM m_mg WHERE k_ = n_ AND n_ >= 2),
m_wd AS (SELECT {k}Weekday AS weekday, CAST(sum(Revenue) AS DOUBLE) / count(Revenue) AS m FROM tx {gk('Weekday')}),
m_b AS (SELECT {k}weekday AS best_day FROM (
  SELECT x.*, row_number() OVER ({part}ORDER BY m DESC, day_index) AS rn FROM m_wd x JOIN wd USING (weekday)
  WHERE m IS NOT NULL) t WHERE rn = 1),
metrics AS (
  SELECT {sel_key}m_s.total_revenue, m_s.total_transactions, m_s.total_customers, m_s.total_products, m_s.date_start,
    m_s.date_end, m_s.avg_transaction_value,
    coalesce(m_c.customer_count, 0) AS customer_count, coalesce(m_c.one_time_customers, 0) AS one_time_customers,
    coalesce(m_c.avg_customer_value, 0.0) AS avg_customer_value, coalesce(m_p.product_rows, 0) AS product_rows,
    m_p.avg_product_price, m_g.revenue_mom, m_g.revenue_trend, m_t.top_product_name, m_t.top_product_revenue, m_b.best_day
  FROM m_s LEFT JOIN m_c ON {on('m_s', 'm_c')} LEFT JOIN m_p ON {on('m_s', 'm_p')} LEFT JOIN m_g ON {on('m_s', 'm_g')}
  LEFT JOIN m_t ON {on('m_s', 'm_t')} LEFT JOIN m_b ON {on('m_s', 'm_b')}),
m_h AS (
  SELECT *,
    greatest(0.0, least(100.0, CAST(50 AS DOUBLE) + CASE WHEN total_revenue > 10000 THEN 10 ELSE 0 END
      + CASE WHEN total_transactions > 100 THEN 10 ELSE 0 END
      + CASE WHEN revenue_mom > 0 THEN least(20.0, revenue_mom) WHEN revenue_mom < 0 THEN -least(10.0, abs(revenue_mom))
             ELSE 0.0 END)) AS revenue_health,
    greatest(0.0, least(100.0, CAST(50 AS DOUBLE) + CASE WHEN customer_count > 50 THEN 20 WHEN customer_count > 10 THEN 10 ELSE 0 END
      + CASE WHEN one_time_customers < customer_count * 0.5 THEN 10 ELSE 0 END)) AS customer_health,
    greatest(0.0, least(100.0, CAST(50 AS DOUBLE) + CASE WHEN product_rows > 20 THEN 20 WHEN product_rows > 5 THEN 10 ELSE 0 END))
      AS product_health
  FROM metrics),
im AS (
  SELECT *, round(revenue_health * 0.5 + customer_health * 0.3 + product_health * 0.2, 1) AS overall_health,
    CASE WHEN round(revenue_health * 0.5 + customer_health * 0.3 + product_health * 0.2, 1) >= 70 THEN 'healthy'
         WHEN round(revenue_health * 0.5 + customer_health * 0.3 + product_health * 0.2, 1) >= 40 THEN 'stable'
         ELSE 'needs attention' END AS health_status
  FROM m_h)"""


def _k(key):
    return f"{key}, " if key else ""


HEALTH_COLS = "CAST(revenue_health AS DOUBLE) AS revenue_health, CAST(customer_health AS DOUBLE) AS customer_health, " \
              "CAST(product_health AS DOUBLE) AS product_health, CAST(overall_health AS DOUBLE) AS overall_health"

register("kpi_health_scores", lambda s, d: health_scores(tx(s, d)),
         sql("tx", f"SELECT {HEALTH_COLS} FROM im", ctes=metrics_ctes()))
register("kpi_health_scores_by_region", lambda s, d: health_scores(keyed(s, d), ["Region"]),
         sql("keyed", f"SELECT Region, {HEALTH_COLS} FROM im", ctes=metrics_ctes("Region")))

register("ins_health_status",
         lambda s, d: I.insight_metrics(tx(s, d)).select("overall_health", "health_status"),
         sql("tx", "SELECT CAST(overall_health AS DOUBLE) AS overall_health, health_status FROM im", ctes=metrics_ctes()))

MONEY_TXT = "format('{{:,.2f}}', round({x}, 2))"
FIX2 = "printf('%.2f', round({x}, 2))"
FIX1 = "printf('%.1f', round({x}, 1))"
INT_TXT = "format('{{:,}}', CAST({x} AS BIGINT))"


def key_insights_sql(key=None):
    k = _k(key)
    rate = "(CAST(one_time_customers AS DOUBLE) / greatest(customer_count, 1) * 100)"
    top_rev = "coalesce(top_product_revenue, 0.0)"
    return f"""
SELECT {k}CAST(1 AS BIGINT) AS position, 'Revenue Performance' AS title,
  'Total revenue of $' || {MONEY_TXT.format(x='total_revenue')} || ' from ' || {INT_TXT.format(x='total_transactions')}
    || ' transactions. Average order value is $' || {FIX2.format(x='avg_transaction_value')} || '. Best day: '
    || coalesce(best_day, 'N/A') || '.' AS description,
  CASE WHEN total_revenue > 10000 THEN 'high' ELSE 'medium' END AS impact, 'revenue' AS category,
  CAST(0.95 AS DOUBLE) AS confidence, '{I.REC_REVENUE}' AS recommendation
FROM im WHERE avg_transaction_value > 0
UNION ALL
SELECT {k}2, 'Customer Retention',
  {FIX1.format(x=rate)} || '% of customers are one-time buyers (' || CAST(one_time_customers AS VARCHAR) || ' of '
    || CAST(customer_count AS VARCHAR) || '). Average customer lifetime value is $' || {FIX2.format(x='avg_customer_value')} || '.',
  CASE WHEN {rate} > 60 THEN 'high' ELSE 'medium' END, 'customer', CAST(0.9 AS DOUBLE), '{I.REC_CUSTOMER}'
FROM im WHERE one_time_customers > 0 AND customer_count > 0
UNION ALL
SELECT {k}3, 'Product Portfolio',
  'Active product catalog of ' || CAST(product_rows AS VARCHAR) || ' items. Top product '''
    || substr(coalesce(top_product_name, 'No data'), 1, 30) || '...'' generates $' || {MONEY_TXT.format(x=top_rev)} || ' in revenue.',
  'medium', 'product', CAST(0.85 AS DOUBLE), '{I.REC_PRODUCT}'
FROM im WHERE product_rows > 0 AND {top_rev} > 0
UNION ALL
SELECT {k}4, 'Growth Trajectory',
  'Month-over-month revenue growth is ' || {FIX1.format(x='revenue_mom')} || '% ('
    || CASE WHEN revenue_mom > 0 THEN 'positive' ELSE 'negative' END || ' trend).',
  'high', 'revenue', CAST(0.9 AS DOUBLE),
  'Investigate drivers of ' || CASE WHEN revenue_mom > 0 THEN 'growth' ELSE 'decline' END || ' and '
    || CASE WHEN revenue_mom > 0 THEN 'scale' ELSE 'address' END || ' accordingly.'
FROM im WHERE revenue_mom IS NOT NULL"""


def opportunities_sql(key=None):
    k = _k(key)
    o = I.OPPORTUNITIES
    return f"""
SELECT {k}CAST(1 AS BIGINT) AS position, '{o[0][0]}' AS opportunity, '{o[0][1]}' AS potential_impact, '{o[0][2]}' AS effort_required
FROM im WHERE one_time_customers > customer_count * 0.5
UNION ALL SELECT {k}2, '{o[1][0]}', '{o[1][1]}', '{o[1][2]}' FROM im
UNION ALL SELECT {k}3, '{o[2][0]}', '{o[2][1]}', '{o[2][2]}' FROM im WHERE product_rows < 50"""


def risks_sql(key=None):
    k = _k(key)
    c, dcl = I.RISK_CHURN, I.RISK_DECLINE
    conc = "(coalesce(top_product_revenue, 0.0) / nullif(total_revenue, 0) * 100)"
    return f"""
SELECT {k}CAST(1 AS BIGINT) AS position, '{c[0]}' AS risk, '{c[1]}' AS severity, '{c[2]}' AS mitigation
FROM im WHERE one_time_customers > customer_count * 0.7
UNION ALL SELECT {k}2, '{dcl[0]}', '{dcl[1]}', '{dcl[2]}' FROM im WHERE coalesce(revenue_mom, 0.0) < -10
UNION ALL SELECT {k}3, 'High revenue concentration: Top product represents ' || {FIX1.format(x=conc)} || '% of revenue',
  'medium', '{I.RISK_CONCENTRATION_MITIGATION}'
FROM im WHERE total_revenue > 0 AND coalesce(top_product_revenue, 0.0) > 0 AND {conc} > 40"""


SUMMARY_TXT = f"""'Business performance is ' || health_status || ' with $' || {MONEY_TXT.format(x='total_revenue')}
  || ' revenue from ' || {INT_TXT.format(x='total_transactions')} || ' transactions. Customer base consists of '
  || {INT_TXT.format(x='total_customers')} || ' customers with average transaction value of $'
  || {FIX2.format(x='avg_transaction_value')} || '. '
  || upper(substr(coalesce(revenue_trend, 'stable'), 1, 1)) || lower(substr(coalesce(revenue_trend, 'stable'), 2))
  || ' revenue trend with ' || {FIX1.format(x='abs(coalesce(revenue_mom, 0.0))')} || '% '
  || CASE WHEN coalesce(revenue_mom, 0.0) > 0 THEN 'growth' ELSE 'decline' END
  || ' month-over-month. Best performing day is ' || coalesce(best_day, 'N/A') || '.'"""


def _im(base_fn, by):
    return lambda s, d: I.insight_metrics(base_fn(s, d), by)


register("ins_key_insights", lambda s, d: I.key_insights(I.insight_metrics(tx(s, d))),
         sql("tx", key_insights_sql(), ctes=metrics_ctes()))
register("ins_key_insights_by_country", lambda s, d: I.key_insights(I.insight_metrics(tx(s, d), ["Country"]), ["Country"]),
         sql("tx", key_insights_sql("Country"), ctes=metrics_ctes("Country")))
register("ins_growth_opportunities", lambda s, d: I.growth_opportunities(I.insight_metrics(tx(s, d))),
         sql("tx", opportunities_sql(), ctes=metrics_ctes()))
register("ins_risk_warnings", lambda s, d: I.risk_warnings(I.insight_metrics(tx(s, d))),
         sql("tx", risks_sql(), ctes=metrics_ctes()))
register("ins_risk_warnings_by_country",
         lambda s, d: I.risk_warnings(I.insight_metrics(tx(s, d), ["Country"]), ["Country"]),
         sql("tx", risks_sql("Country"), ctes=metrics_ctes("Country")))
register("ins_summary_text", lambda s, d: (lambda m: m.select(I.summary_text(m).alias("executive_summary")))(
    I.insight_metrics(tx(s, d))), sql("tx", f"SELECT {SUMMARY_TXT} AS executive_summary FROM im", ctes=metrics_ctes()))
REC_SQL = " UNION ALL ".join(f"SELECT {{k}}CAST({i + 1} AS BIGINT) AS position, '{t}' AS recommendation FROM im"
                             for i, t in enumerate(I.TOP_RECOMMENDATIONS))
register("ins_recommendations", lambda s, d: I.recommendations(I.insight_metrics(tx(s, d))),
         sql("tx", REC_SQL.format(k=""), ctes=metrics_ctes()))


def all_sql(key=None):
    k = _k(key)
    j = f"USING ({key})" if key else "ON true"
    return f"""
SELECT {('im.' + key + ', ') if key else ''}health_status, CAST(overall_health AS DOUBLE) AS overall_health, {SUMMARY_TXT} AS executive_summary,
  CAST(coalesce(ki.n, 0) AS BIGINT) AS insight_count, CAST(coalesce(go.n, 0) AS BIGINT) AS opportunity_count,
  CAST(coalesce(rw.n, 0) AS BIGINT) AS risk_count, total_transactions >= 10 AS enough_data, 'rules' AS engine
FROM im
LEFT JOIN (SELECT {k}count(*) AS n FROM ({key_insights_sql(key)}) t {('GROUP BY ' + key) if key else ''}) ki {j}
LEFT JOIN (SELECT {k}count(*) AS n FROM ({opportunities_sql(key)}) t {('GROUP BY ' + key) if key else ''}) go {j}
LEFT JOIN (SELECT {k}count(*) AS n FROM ({risks_sql(key)}) t {('GROUP BY ' + key) if key else ''}) rw {j}"""


register("ins_all", lambda s, d: I.assemble(I.insight_metrics(tx(s, d))), sql("tx", all_sql(), ctes=metrics_ctes()))
register("ins_all_by_country", lambda s, d: I.assemble(I.insight_metrics(tx(s, d), ["Country"]), ["Country"]),
         sql("tx", all_sql("Country"), ctes=metrics_ctes("Country")))

PROMPT_SQL = f"""
SELECT concat_ws(chr(10),
  'Analyze the following business metrics and generate actionable insights.', '', 'DATASET INFORMATION:',
  '- Time Period: ' || coalesce(date_start, 'N/A') || ' to ' || coalesce(date_end, 'N/A'),
  '- Total Rows: ' || (SELECT count(*) FROM tx), '- Data Type: Retail transactions', '', 'BUSINESS METRICS:', '', 'SUMMARY METRICS:',
  '- Total Revenue: $' || {MONEY_TXT.format(x='total_revenue')},
  '- Total Transactions: ' || {INT_TXT.format(x='total_transactions')},
  '- Total Customers: ' || {INT_TXT.format(x='total_customers')},
  '- Average Transaction Value: $' || {FIX2.format(x='avg_transaction_value')},
  '- Total Products: ' || {INT_TXT.format(x='total_products')}, '', 'REVENUE ANALYSIS:',
  '- Monthly Revenue Trend: [' || (SELECT string_agg('(''' || period || ''', ' || {FIX2.format(x='revenue')} || ')', ', ' ORDER BY period)
     FROM (SELECT * FROM ({ORACLE["kpi_monthly_revenue"]}) t ORDER BY period DESC LIMIT 3) t) || ']',
  '- Best Performing Day: ' || coalesce(best_day, 'N/A'),
  (SELECT '- Revenue Distribution - Mean: $' || {FIX2.format(x='mean')} || ', Median: $' || {FIX2.format(x='median')}
     FROM ({ORACLE["kpi_revenue_distribution"]}) t), '', 'CUSTOMER ANALYSIS:',
  '- Total Customers: ' || {INT_TXT.format(x='customer_count')},
  '- One-time Customers: ' || {INT_TXT.format(x='one_time_customers')} || ' ('
    || {FIX1.format(x='round(CAST(one_time_customers AS DOUBLE) / greatest(customer_count, 1) * 100, 1)')} || '%)',
  '- Average Customer Value: $' || {FIX2.format(x='avg_customer_value')},
  '- Segment Distribution: {{' || (SELECT string_agg('''' || segment || ''': ' || customers, ', '
     ORDER BY customers DESC, list_position(['Low', 'Medium', 'High', 'VIP'], segment)) FROM ({ORACLE["kpi_segment_distribution"]}) t) || '}}',
  (SELECT '- RFM Scores - Recency: ' || {FIX1.format(x='avg_recency')} || ' days, Frequency: ' || {FIX1.format(x='avg_frequency')}
     || ', Monetary: $' || {FIX2.format(x='avg_monetary')} FROM ({ORACLE["kpi_rfm_summary"]}) t), '', 'PRODUCT ANALYSIS:',
  '- Total Products: ' || {INT_TXT.format(x='product_rows')},
  '- Top Product: ' || coalesce(top_product_name, 'No data') || ' ($' || {MONEY_TXT.format(x='coalesce(top_product_revenue, 0.0)')} || ')',
  '- Average Product Price: $' || {FIX2.format(x='avg_product_price')}, '', 'GROWTH METRICS:',
  '- Month-over-Month Growth: ' || coalesce({FIX2.format(x='revenue_mom')}, 'N/A') || '%',
  '- Overall Trend: ' || coalesce(revenue_trend, 'stable'), '',
  '{I.REPLY_FORMAT}', '', '{I.FOCUS}') AS prompt
FROM im"""
register("ins_prompt", lambda s, d: I.prompt_text(I.prompt_metrics(tx(s, d))), sql("tx", PROMPT_SQL, ctes=metrics_ctes()))

VALID_JSON = """(json_valid(props) AND json_type(props) = 'OBJECT')"""
STRUCT_OK = f"""({VALID_JSON} AND list_contains(json_keys(props), 'executive_summary')
  AND list_contains(json_keys(props), 'key_insights') AND list_contains(json_keys(props), 'top_recommendations')
  AND json_type(props, '$.key_insights') = 'ARRAY' AND json_type(props, '$.top_recommendations') = 'ARRAY')"""
def _replies(s, d):
    """Event payloads as they are, and one reply per nation: a third fit, a third have an object for a list, a third lack a field."""
    events = table(s, d, "events", "props").select(F.lit("events").alias("kind"), F.col("props").alias("reply"))
    k = F.col("n_nationkey") % 3
    lists = F.to_json(F.struct(F.col("n_name").alias("executive_summary"), F.array(F.struct(F.col("n_name").alias("title"))).alias("key_insights"),
                               F.when(k != 2, F.array("n_name")).alias("top_recommendations")))
    wrong = F.to_json(F.struct(F.col("n_name").alias("executive_summary"), F.struct(F.col("n_name").alias("title")).alias("key_insights"),
                               F.array("n_name").alias("top_recommendations")))
    made = table(s, d, "nation", "n_nationkey", "n_name").select(F.lit("nations").alias("kind"), F.when(k == 1, wrong).otherwise(lists).alias("reply"))
    return I.validate_replies(events.unionByName(made), "reply", ["kind"])


register("ins_validate_json", _replies, sql("none", f"""
SELECT 'events' AS kind, count(*) AS replies, count(*) FILTER (WHERE coalesce({VALID_JSON}, false)) AS parsed_objects,
  count(*) FILTER (WHERE NOT coalesce({VALID_JSON}, false)) AS malformed,
  count(*) FILTER (WHERE coalesce({STRUCT_OK}, false)) AS valid,
  count(*) FILTER (WHERE coalesce({VALID_JSON}, false) AND NOT coalesce({STRUCT_OK}, false)) AS invalid_structure
FROM events
UNION ALL SELECT 'nations', count(*), count(*), 0, count(*) FILTER (WHERE n_nationkey % 3 = 0), count(*) FILTER (WHERE n_nationkey % 3 <> 0)
FROM nation"""))


def _insight_documents(s, d):
    """All nations are businesses, and one more per region, which has no sales."""
    names = table(s, d, "nation", "n_name").select(F.col("n_name").alias("Country"))
    keys = names.unionByName(table(s, d, "region", "r_name").select(F.col("r_name").alias("Country")))
    docs = I.documents(I.insight_metrics(tx(s, d), ["Country"]), ["Country"], keys)
    return docs.select("Country", "executive_summary", F.array_join(F.transform("key_insights", lambda x: x["title"]), "|").alias("insights"),
                       F.array_join(F.transform("growth_opportunities", lambda x: x["opportunity"]), "|").alias("opportunities"),
                       F.array_join(F.transform("risk_warnings", lambda x: x["risk"]), "|").alias("risks"),
                       F.array_join("top_recommendations", "|").alias("recommendations"), "note")


register("ins_documents", _insight_documents, sql("tx", f"""
SELECT Country, {SUMMARY_TXT} AS executive_summary,
  coalesce((SELECT string_agg(title, '|' ORDER BY position) FROM ({key_insights_sql('Country')}) x WHERE x.Country = im.Country), '') AS insights,
  coalesce((SELECT string_agg(opportunity, '|' ORDER BY position) FROM ({opportunities_sql('Country')}) x WHERE x.Country = im.Country), '') AS opportunities,
  coalesce((SELECT string_agg(risk, '|' ORDER BY position) FROM ({risks_sql('Country')}) x WHERE x.Country = im.Country), '') AS risks,
  '{"|".join(I.TOP_RECOMMENDATIONS)}' AS recommendations, CAST(NULL AS VARCHAR) AS note
FROM im
UNION ALL
SELECT name, '{I.FALLBACK_SUMMARY}', '{I.FALLBACK_INSIGHT[0]}', '', '', '{"|".join(I.FALLBACK_RECOMMENDATIONS)}', '{I.FALLBACK_NOTE}'
FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region) k WHERE name NOT IN (SELECT Country FROM im)""", ctes=metrics_ctes("Country")))


# ----------------------------------------------------------------------------------- K21/K22
SOURCE_KEYS = {
    "summary": "kpi_summary", "monthly": "kpi_monthly_revenue", "quarterly": "kpi_quarterly_revenue",
    "weekday": "kpi_weekday_revenue", "distribution": "kpi_revenue_distribution",
    "customer_overview": "kpi_customer_overview", "segments": "kpi_segment_distribution",
    "rfm_summary": "kpi_rfm_summary", "top_customers": "top_customers", "product_overview": "kpi_product_overview",
    "top_products": "top_products", "weekday_pattern": "kpi_weekday_pattern", "seasonality": "kpi_seasonality",
    "geo_overview": "kpi_geo_overview", "top_countries": "top_countries", "growth": "win_mom_growth",
    "health": "kpi_health_scores",
}


def long_sql() -> str:
    parts = []
    for section, group, source, key, values, texts in SPEC:
        src = ORACLE[SOURCE_KEYS[source]]
        if source == "growth":
            src = f"SELECT * FROM ({src}) g WHERE is_latest"
        k = f"CAST({key} AS VARCHAR)" if key else "''"
        for m in values:
            name = f"{group}.{m}" if group else m
            parts.append(f"SELECT '{section}' AS section, '{name}' AS metric, {k} AS key, CAST({m} AS DOUBLE) AS value, "
                         f"CAST(NULL AS VARCHAR) AS text FROM ({src}) s")
        for m in texts:
            name = f"{group}.{m}" if group else m
            parts.append(f"SELECT '{section}', '{name}', {k}, CAST(NULL AS DOUBLE), CAST({m} AS VARCHAR) FROM ({src}) s")
    return "\nUNION ALL\n".join(parts)


def _long(s, d):
    t = tx(s, d)
    return long_metrics(t)


register("kpi_all", _long, long_sql())
register("kpi_metric_count", lambda s, d: metric_count(long_metrics(tx(s, d))),
         f"SELECT count(*) AS metric_count FROM ({long_sql()}) t WHERE value IS NOT NULL OR text IS NOT NULL")
