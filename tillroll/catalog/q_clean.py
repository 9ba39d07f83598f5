"""Registered queries: cleaning (C), projections / filters (P), validation (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.catalog import register
from tillroll.catalog.bases import BASES, IN_RANGE_SQL, STRIP_SQL, cleaned, derive_sql, keyed_sql, output, sql, tx
from tillroll.operators import clean as C
from tillroll.operators import kpi as K
from tillroll.operators import validate as V
from tillroll.sources.fixtures import dirty
from tillroll.sources.tables import table

RAW8 = "InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country"

CLEAN_COLS_SQL = """InvoiceNo, StockCode, Description, Quantity, InvoiceDate, CAST(UnitPrice AS DOUBLE) AS UnitPrice,
  CustomerID, Country, CAST(TransactionValue AS DOUBLE) AS TransactionValue, IsReturn,
  CAST(SalesRevenue AS DOUBLE) AS SalesRevenue, CAST(ReturnsValue AS DOUBLE) AS ReturnsValue,
  CAST(NetRevenue AS DOUBLE) AS NetRevenue, CAST(Revenue AS DOUBLE) AS Revenue,
  CAST(Year AS BIGINT) AS Year, CAST(Month AS BIGINT) AS Month, MonthName, CAST(Quarter AS BIGINT) AS Quarter,
  Weekday, CAST(DayOfMonth AS BIGINT) AS DayOfMonth, CAST(Hour AS BIGINT) AS Hour, Date, TransactionRef,
  DataQualityScore, QualityFlag, NeedsReview"""

# C1
register("clean_fill_constants", lambda s, d: C.fill_constants(dirty(s, d)), sql("dirty", f"""
SELECT InvoiceNo, StockCode, coalesce(Description, 'Unknown Product') AS Description, coalesce(Quantity, '0') AS Quantity,
  InvoiceDate, coalesce(UnitPrice, '0') AS UnitPrice, coalesce(CustomerID, 'Unknown') AS CustomerID, Country
FROM dirty"""))

# C2
register("clean_fill_mode", lambda s, d: C.fill_mode(dirty(s, d)), sql("prepared", f"""
SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID,
  coalesce(Country, (SELECT m FROM c_mode), 'Unknown') AS Country
FROM dirty"""))

# C3
register("clean_fill_report", lambda s, d: C.fill_report(dirty(s, d)), sql("dirty", """
SELECT * FROM (
  SELECT 'CustomerID' AS "column", count(*) FILTER (WHERE CustomerID IS NULL) AS filled FROM dirty
  UNION ALL SELECT 'Description', count(*) FILTER (WHERE Description IS NULL) FROM dirty
  UNION ALL SELECT 'Country', count(*) FILTER (WHERE Country IS NULL) FROM dirty
  UNION ALL SELECT 'Quantity', count(*) FILTER (WHERE Quantity IS NULL) FROM dirty
  UNION ALL SELECT 'UnitPrice', count(*) FILTER (WHERE UnitPrice IS NULL) FROM dirty) t
WHERE filled > 0"""))

# C4
PREPARED_COLS_SQL = "* REPLACE (CAST(UnitPrice AS DOUBLE) AS UnitPrice)"
register("clean_cast", lambda s, d: output(C.prepare(dirty(s, d))), sql("prepared", f"SELECT {PREPARED_COLS_SQL} FROM prepared"))

# C5
register("clean_filter_invalid", lambda s, d: output(C.filter_invalid(C.prepare(dirty(s, d)))), sql("prepared", f"""
SELECT {PREPARED_COLS_SQL} FROM prepared WHERE InvoiceDate IS NOT NULL AND UnitPrice > 0 AND Quantity <> 0 AND {IN_RANGE_SQL}"""))

# C6
register("clean_removal_report", lambda s, d: C.removal_report(C.prepare(dirty(s, d))), sql("prepared", f"""
SELECT reason, removed FROM (
  SELECT CASE WHEN InvoiceDate IS NULL THEN 'invalid_dates' WHEN UnitPrice <= 0 THEN 'invalid_prices'
              WHEN Quantity = 0 THEN 'zero_quantity' WHEN NOT {IN_RANGE_SQL} THEN 'out_of_range' END AS reason, count(*) AS removed
  FROM prepared GROUP BY 1) t
WHERE reason IS NOT NULL AND removed > 0
UNION ALL
SELECT 'total_removed', count(*) FROM prepared
WHERE InvoiceDate IS NULL OR UnitPrice <= 0 OR Quantity = 0 OR NOT {IN_RANGE_SQL}"""))

# C7
register("clean_text", lambda s, d: C.valid_rows(dirty(s, d)).select("InvoiceNo", "StockCode", "Description", "Country"),
         sql("valid", "SELECT InvoiceNo, StockCode, Description, Country FROM valid"))

# C8
register("clean_revenue",
         lambda s, d: output(C.revenue_columns(C.valid_rows(dirty(s, d))).select(
             "InvoiceNo", "StockCode", "Quantity", "TransactionValue", "IsReturn", "SalesRevenue", "ReturnsValue",
             "NetRevenue", "Revenue")),
         sql("valid", """
SELECT InvoiceNo, StockCode, Quantity, CAST(TransactionValue AS DOUBLE) AS TransactionValue, IsReturn,
  CAST(SalesRevenue AS DOUBLE) AS SalesRevenue, CAST(ReturnsValue AS DOUBLE) AS ReturnsValue,
  CAST(NetRevenue AS DOUBLE) AS NetRevenue, CAST(Revenue AS DOUBLE) AS Revenue
FROM vd""", ctes=derive_sql("valid", "vd")))

# C9
register("clean_return_rate", lambda s, d: C.return_rate(C.valid_rows(dirty(s, d))), sql("valid", """
SELECT CAST(round(sum(SalesRevenue), 2) AS DOUBLE) AS gross_sales, CAST(round(sum(ReturnsValue), 2) AS DOUBLE) AS total_returns,
  CAST(round(sum(SalesRevenue) - sum(ReturnsValue), 2) AS DOUBLE) AS net_revenue,
  CAST(round(coalesce(CASE WHEN sum(SalesRevenue) > 0 THEN sum(ReturnsValue) / sum(SalesRevenue) * 100 END, 0), 2) AS DOUBLE) AS return_rate
FROM vd""", ctes=derive_sql("valid", "vd")))

# C10
register("clean_date_parts",
         lambda s, d: output(C.date_parts(C.valid_rows(dirty(s, d))).select(
             "InvoiceNo", "StockCode", "InvoiceDate", "Year", "Month", "MonthName", "Quarter", "Weekday",
             "DayOfMonth", "Hour", "Date")),
         sql("valid", """
SELECT InvoiceNo, StockCode, InvoiceDate, year(InvoiceDate) AS Year, month(InvoiceDate) AS Month,
  monthname(InvoiceDate) AS MonthName, quarter(InvoiceDate) AS Quarter, dayname(InvoiceDate) AS Weekday,
  day(InvoiceDate) AS DayOfMonth, hour(InvoiceDate) AS Hour, CAST(InvoiceDate AS DATE) AS Date
FROM valid"""))

# C11
register("clean_txn_ref", lambda s, d: C.transaction_ref(C.valid_rows(dirty(s, d))).select("TransactionRef"),
         sql("valid", "SELECT InvoiceNo || '_' || StockCode AS TransactionRef FROM valid"))

# C12
register("clean_quality_flags",
         lambda s, d: output(C.quality_flags(C.valid_rows(dirty(s, d))).select(
             "InvoiceNo", "StockCode", "Quantity", "UnitPrice", "DataQualityScore", "QualityFlag")),
         sql("cleaned", """
SELECT x.InvoiceNo, x.StockCode, x.Quantity, CAST(x.UnitPrice AS DOUBLE) AS UnitPrice,
  CAST(1.0 AS DOUBLE)
    * (CASE WHEN x.Quantity > q.q99q * 3 THEN CAST(0.7 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END)
    * (CASE WHEN CAST(x.UnitPrice AS DOUBLE) > q.q99p * 3 THEN CAST(0.7 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) AS DataQualityScore,
  CASE WHEN CAST(x.UnitPrice AS DOUBLE) > q.q99p * 3 THEN 'Extreme price'
       WHEN x.Quantity > q.q99q * 3 THEN 'Extreme quantity' END AS QualityFlag
FROM valid x CROSS JOIN c_q99 q"""))

# C13
register("clean_dedup", lambda s, d: output(C.dedup(C.valid_rows(dirty(s, d)))), sql("cleaned", f"SELECT {PREPARED_COLS_SQL} FROM c_dedup"))

# C14
register("clean_multi_entries", lambda s, d: C.multi_entries(C.dedup(C.valid_rows(dirty(s, d)))), sql("cleaned", """
SELECT count(*) AS legitimate_multiple_entries, CAST(sum(n) AS BIGINT) AS total_multiple_entry_rows
FROM (SELECT InvoiceNo, StockCode, count(*) AS n FROM c_dedup GROUP BY 1, 2 HAVING count(*) > 1) t"""))

# C15
register("clean_suspicious",
         lambda s, d: C.suspicious(C.dedup(C.valid_rows(dirty(s, d)))).select(
             "InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "NeedsReview"),
         sql("cleaned", """
SELECT InvoiceNo, StockCode, Quantity, InvoiceDate,
  CASE WHEN count(*) OVER (PARTITION BY InvoiceNo, date_trunc('minute', InvoiceDate)) > 3 THEN true END AS NeedsReview
FROM c_dedup"""))

# C16
from tillroll.plans.report import clean_report  # noqa: E402



def report_sql(key: str | None = None) -> str:
    """The report from the stages of the chain, for all rows or per ``key``."""
    k, g, using = (f"{key}, ", f" GROUP BY {key}", f" JOIN {{}} USING ({key})") if key else ("", "", " CROSS JOIN {}")
    stat = lambda step, name: f"SELECT {k}'{step}' AS step, '{name}' AS stat, CAST({name} AS DOUBLE) AS value FROM w"
    counted = ([("missing_value_handling", f"{c}_filled") for c in ("CustomerID", "Description", "Country", "Quantity", "UnitPrice")]
               + [("type_conversion", "invalid_dates_found")]
               + [("invalid_row_removal", r) for r in ("invalid_dates", "invalid_prices", "zero_quantity", "out_of_range")]
               + [("duplicate_removal", r) for r in ("exact_duplicates_removed", "legitimate_multiple_entries", "total_multiple_entry_rows",
                                                     "suspicious_transactions_for_review")])
    always = [("invalid_row_removal", "total_removed"), ("derived_columns", "gross_sales"), ("derived_columns", "total_returns"),
              ("derived_columns", "net_revenue"), ("derived_columns", "return_rate"), ("duplicate_removal", "final_rows"),
              ("duplicate_removal", "rows_removed"), ("duplicate_removal", "removal_rate"), ("summary", "original_rows"),
              ("summary", "original_columns"), ("summary", "final_columns"), ("summary", "rows_removed_percentage")]
    return f"""
a AS (SELECT {k}count(*) AS original_rows, count(*) FILTER (WHERE CustomerID IS NULL) AS CustomerID_filled,
  count(*) FILTER (WHERE Description IS NULL) AS Description_filled, count(*) FILTER (WHERE Country IS NULL) AS Country_filled,
  count(*) FILTER (WHERE Quantity IS NULL) AS Quantity_filled, count(*) FILTER (WHERE UnitPrice IS NULL) AS UnitPrice_filled
  FROM dirty{g}),
b AS (SELECT {k}count(*) FILTER (WHERE InvoiceDate IS NULL) AS invalid_dates_found, count(*) FILTER (WHERE InvoiceDate IS NULL) AS invalid_dates,
  count(*) FILTER (WHERE InvoiceDate IS NOT NULL AND UnitPrice <= 0) AS invalid_prices,
  count(*) FILTER (WHERE InvoiceDate IS NOT NULL AND UnitPrice > 0 AND Quantity = 0) AS zero_quantity,
  count(*) FILTER (WHERE InvoiceDate IS NOT NULL AND UnitPrice > 0 AND Quantity <> 0 AND NOT {IN_RANGE_SQL}) AS out_of_range
  FROM prepared{g}),
v AS (SELECT {k}count(*) AS valid_rows, CAST(round(sum(SalesRevenue), 2) AS DOUBLE) AS gross_sales,
  CAST(round(sum(ReturnsValue), 2) AS DOUBLE) AS total_returns, CAST(round(sum(SalesRevenue) - sum(ReturnsValue), 2) AS DOUBLE) AS net_revenue,
  round(coalesce(CASE WHEN sum(SalesRevenue) > 0 THEN CAST(sum(ReturnsValue) AS DOUBLE) / CAST(sum(SalesRevenue) AS DOUBLE) * 100 END, 0), 2) AS return_rate
  FROM vd{g}),
m AS (SELECT {k}count(*) FILTER (WHERE n > 1) AS legitimate_multiple_entries, coalesce(sum(n) FILTER (WHERE n > 1), 0) AS total_multiple_entry_rows
  FROM (SELECT {k}count(*) AS n FROM c_dedup GROUP BY {k}InvoiceNo, StockCode) t{g}),
f AS (SELECT {k}count(*) AS final_rows, count(*) FILTER (WHERE NeedsReview) AS suspicious_transactions_for_review FROM cleaned{g}),
w AS (SELECT *, valid_rows - final_rows AS exact_duplicates_removed, valid_rows - final_rows AS rows_removed,
  original_rows - valid_rows AS total_removed, round(CAST(valid_rows - final_rows AS DOUBLE) / valid_rows * 100, 2) AS removal_rate,
  8 AS original_columns, 26 AS final_columns, original_rows - final_rows AS all_removed,
  round((1 - CAST(final_rows AS DOUBLE) / original_rows) * 100, 2) AS rows_removed_percentage
  FROM a{using.format("b")}{using.format("v")}{using.format("m")}{using.format("f")})
SELECT * FROM ({" UNION ALL ".join(stat(*c) for c in counted)}) t WHERE value > 0
UNION ALL {" UNION ALL ".join(stat(*c) for c in always)}
UNION ALL SELECT {k}'summary', 'final_rows', CAST(final_rows AS DOUBLE) FROM w
UNION ALL SELECT {k}'summary', 'rows_removed', CAST(all_removed AS DOUBLE) FROM w"""


register("clean_report", lambda s, d: clean_report(dirty(s, d)),
         f"WITH {BASES['cleaned']},\n{derive_sql('valid', 'vd')},{report_sql()}")
register("clean_report_by_region", lambda s, d: clean_report(dirty(s, d, keyed=True), ["Region"]),
         f"WITH {keyed_sql(BASES['cleaned'])},\n{derive_sql('valid', 'vd')},{report_sql('Region')}")

# C17
register("clean_chain", lambda s, d: output(cleaned(s, d)), sql("cleaned", f"SELECT {CLEAN_COLS_SQL} FROM cleaned"))

# C18
register("clean_sanitize",
         lambda s, d: C.sanitize(table(s, d, "conversations", "conv_id", "turn", "role", "text"),
                                 ["text"]),
         sql("none", f"""
SELECT conv_id, turn, role,
  regexp_replace({STRIP_SQL.format(x="regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f]', '', 'g')")}, '\\s+', ' ', 'g') AS text
FROM conversations"""))

# ------------------------------------------------------------------ P: filters, projections
register("filter_known_customers",
         lambda s, d: output(K.known_customers(cleaned(s, d)).select("InvoiceNo", "StockCode", "CustomerID", "Revenue")),
         sql("ctx", """
SELECT InvoiceNo, StockCode, CustomerID, CAST(Revenue AS DOUBLE) AS Revenue FROM tx
WHERE CustomerID IS NOT NULL AND CustomerID <> 'Unknown'"""))

register("filter_returns",
         lambda s, d: output(tx(s, d).where(F.col("IsReturn")).select("InvoiceNo", "StockCode", "Quantity", "ReturnsValue")),
         sql("tx", "SELECT InvoiceNo, StockCode, Quantity, CAST(ReturnsValue AS DOUBLE) AS ReturnsValue FROM tx WHERE IsReturn"))

register("filter_range",
         lambda s, d: output(tx(s, d).where(F.col("Quantity").between(1, 10) & (F.col("UnitPrice") < 10000))
                             .select("InvoiceNo", "StockCode", "Quantity", "UnitPrice")),
         sql("tx", """
SELECT InvoiceNo, StockCode, Quantity, CAST(UnitPrice AS DOUBLE) AS UnitPrice FROM tx
WHERE Quantity BETWEEN 1 AND 10 AND UnitPrice < 10000"""))

CUST_SPEND_SQL = """cs AS (
  SELECT CustomerID, CAST(round(sum(Revenue), 2) AS DOUBLE) AS total_spent, count(DISTINCT InvoiceNo) AS transaction_count,
    CAST(sum(Quantity) AS BIGINT) AS total_items,
    round(coalesce(CAST(sum(Revenue) AS DOUBLE) / nullif(count(DISTINCT InvoiceNo), 0), 0), 4) AS avg_transaction_value,
    max(InvoiceDate) AS last_date
  FROM tx WHERE CustomerID IS NOT NULL AND CustomerID <> 'Unknown' GROUP BY CustomerID)"""

register("filter_repeat_customers", lambda s, d: K.repeat_customers(tx(s, d)), sql("tx", """
SELECT CustomerID, total_spent, transaction_count, total_items, avg_transaction_value FROM cs WHERE transaction_count > 1""",
                                                                                   ctes=CUST_SPEND_SQL))

register("project_customer_report",
         lambda s, d: K.customer_spend(tx(s, d)).select("CustomerID", "total_spent", "transaction_count", "avg_transaction_value"),
         sql("tx", "SELECT CustomerID, total_spent, transaction_count, avg_transaction_value FROM cs", ctes=CUST_SPEND_SQL))

# ------------------------------------------------------------------ V: validation
CHECKS_SQL = """chk AS (
  SELECT count(*) AS n,
    count(Quantity) AS q_present, count(*) FILTER (WHERE Quantity IS NOT NULL AND try_cast(Quantity AS DOUBLE) IS NULL) AS q_nonnum,
    count(*) FILTER (WHERE try_cast(Quantity AS DOUBLE) < 0) AS q_neg,
    count(UnitPrice) AS p_present, count(*) FILTER (WHERE UnitPrice IS NOT NULL AND try_cast(UnitPrice AS DOUBLE) IS NULL) AS p_nonnum,
    count(*) FILTER (WHERE try_cast(UnitPrice AS DOUBLE) < 0) AS p_neg,
    count(InvoiceDate) AS d_present
  FROM dirty),
dup AS (SELECT coalesce(sum(n - 1), 0) AS duplicate_rows FROM (SELECT count(*) AS n FROM dirty GROUP BY ALL_COLUMNS) t)"""
CHECKS_SQL = CHECKS_SQL.replace("GROUP BY ALL_COLUMNS", f"GROUP BY {RAW8}")

register("val_empty", lambda s, d: V.checks(dirty(s, d)).select(F.col("rows").cast("bigint").alias("rows"),
                                                                 (F.col("rows") == 0).alias("is_empty")),
         sql("dirty", "SELECT n AS rows, n = 0 AS is_empty FROM chk", ctes=CHECKS_SQL))

register("val_all_null",
         lambda s, d: V.checks(dirty(s, d)).selectExpr(
             "stack(3, 'Quantity', Quantity_present = 0, 'UnitPrice', UnitPrice_present = 0, "
             "'InvoiceDate', InvoiceDate_present = 0) as (column, all_null)"),
         sql("dirty", """
SELECT 'Quantity' AS "column", q_present = 0 AS all_null FROM chk
UNION ALL SELECT 'UnitPrice', p_present = 0 FROM chk
UNION ALL SELECT 'InvoiceDate', d_present = 0 FROM chk""", ctes=CHECKS_SQL))

register("val_non_numeric",
         lambda s, d: V.checks(dirty(s, d)).selectExpr(
             "stack(2, 'Quantity', CAST(Quantity_non_numeric AS BIGINT), 'UnitPrice', CAST(UnitPrice_non_numeric AS BIGINT)) "
             "as (column, non_numeric)"),
         sql("dirty", """
SELECT 'Quantity' AS "column", q_nonnum AS non_numeric FROM chk UNION ALL SELECT 'UnitPrice', p_nonnum FROM chk""",
             ctes=CHECKS_SQL))

register("val_duplicate_rows", lambda s, d: V.duplicate_rows(dirty(s, d)),
         sql("dirty", "SELECT CAST(duplicate_rows AS BIGINT) AS duplicate_rows FROM dup", ctes=CHECKS_SQL))

register("val_negative_qty",
         lambda s, d: V.checks(dirty(s, d)).select(F.col("Quantity_negative").cast("bigint").alias("negative_quantity")),
         sql("dirty", "SELECT q_neg AS negative_quantity FROM chk", ctes=CHECKS_SQL))

register("val_negative_price",
         lambda s, d: V.checks(dirty(s, d)).select(F.col("UnitPrice_negative").cast("bigint").alias("negative_price")),
         sql("dirty", "SELECT p_neg AS negative_price FROM chk", ctes=CHECKS_SQL))

VAL_REPORT_SQL = """
SELECT 'error' AS level, 'empty' AS code, CAST(0 AS BIGINT) AS count, 'File contains no data' AS message FROM chk WHERE n = 0
UNION ALL SELECT 'error', 'Quantity_all_null', n, 'Column ''Quantity'' is completely empty' FROM chk WHERE n > 0 AND q_present = 0
UNION ALL SELECT 'warning', 'Quantity_non_numeric', q_nonnum, 'Column ''Quantity'' is not numeric type' FROM chk WHERE n > 0 AND q_present > 0 AND q_nonnum > 0
UNION ALL SELECT 'error', 'UnitPrice_all_null', n, 'Column ''UnitPrice'' is completely empty' FROM chk WHERE n > 0 AND p_present = 0
UNION ALL SELECT 'warning', 'UnitPrice_non_numeric', p_nonnum, 'Column ''UnitPrice'' is not numeric type' FROM chk WHERE n > 0 AND p_present > 0 AND p_nonnum > 0
UNION ALL SELECT 'error', 'InvoiceDate_all_null', n, 'InvoiceDate column is completely empty' FROM chk WHERE n > 0 AND d_present = 0
UNION ALL SELECT 'warning', 'duplicate_rows', CAST(duplicate_rows AS BIGINT), printf('Found %d duplicate rows', CAST(duplicate_rows AS BIGINT)) FROM chk, dup WHERE n > 0 AND duplicate_rows > 0
UNION ALL SELECT 'warning', 'negative_quantity', q_neg, printf('Found %d rows with negative quantities', q_neg) FROM chk WHERE n > 0 AND q_neg > 0
UNION ALL SELECT 'error', 'negative_price', p_neg, printf('Found %d rows with negative prices', p_neg) FROM chk WHERE n > 0 AND p_neg > 0"""

register("val_report", lambda s, d: V.report(dirty(s, d)), sql("dirty", VAL_REPORT_SQL, ctes=CHECKS_SQL))
register("val_report_by_region", lambda s, d: V.report(dirty(s, d, keyed=True), by=["Region"]),
         f"WITH {keyed_sql(BASES['dirty'])},\n" + CHECKS_SQL.replace("SELECT count(*) AS n,", "SELECT Region, count(*) AS n,").replace("FROM dirty),", "FROM dirty GROUP BY Region),")
         .replace("dup AS (SELECT coalesce", "dup AS (SELECT Region, coalesce").replace("FROM (SELECT count(*) AS n FROM dirty GROUP BY", "FROM (SELECT Region, count(*) AS n FROM dirty GROUP BY Region,")
         .replace("Country) t)", "Country) t GROUP BY Region)")
         + VAL_REPORT_SQL.replace("SELECT '", "SELECT Region, '").replace("FROM chk, dup", "FROM chk JOIN dup USING (Region)"))

EMAIL_SQL = r"'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$'"

register("dq_email", lambda s, d: V.email_candidates(table(s, d, "documents", "lang", "text"),
                                                    "text", ["lang"]),
         sql("none", f"""
SELECT lang, count(*) AS candidates, count(*) FILTER (WHERE regexp_matches(t, {EMAIL_SQL})) AS valid,
  count(*) FILTER (WHERE NOT regexp_matches(t, {EMAIL_SQL})) AS invalid
FROM (SELECT lang, unnest(regexp_extract_all(text, '(\\S*@\\S*)', 1)) AS t FROM documents) x
GROUP BY lang"""))

LOADER_FORMATS = list(V.DATE_FORMATS) + ["dd/MM/yyyy HH:mm"]
LOADER_FORMATS_SQL = "['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%Y-%m-%d %H:%M:%S', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M']"

register("dq_date", lambda s, d: V.date_failures(dirty(s, d), "InvoiceDate", formats=LOADER_FORMATS), sql("dirty", f"""
SELECT count(InvoiceDate) AS checked,
  count(*) FILTER (WHERE InvoiceDate IS NOT NULL AND try_strptime(InvoiceDate, {LOADER_FORMATS_SQL}) IS NULL) AS failures
FROM dirty"""))

PROFILE_RULES = [("Quantity", "numeric"), ("UnitPrice", "numeric"), ("UnitPrice", "positive"),
                 ("CustomerID", "numeric"), ("InvoiceDate", "date")]


def _profile(s, d):
    df = dirty(s, d)
    return V.profile_rules(df, PROFILE_RULES, formats=LOADER_FORMATS)


register("dq_profile", _profile, sql("dirty", f"""
SELECT "column", rule, checked, failures, round(coalesce(failures * 100.0 / nullif(checked, 0), 0), 4) AS failure_pct FROM (
  SELECT 'Quantity' AS "column", 'numeric' AS rule, count(Quantity) AS checked,
    count(*) FILTER (WHERE Quantity IS NOT NULL AND try_cast(Quantity AS DOUBLE) IS NULL) AS failures FROM dirty
  UNION ALL SELECT 'UnitPrice', 'numeric', count(UnitPrice),
    count(*) FILTER (WHERE UnitPrice IS NOT NULL AND try_cast(UnitPrice AS DOUBLE) IS NULL) FROM dirty
  UNION ALL SELECT 'UnitPrice', 'positive', count(UnitPrice),
    count(*) FILTER (WHERE try_cast(UnitPrice AS DOUBLE) IS NOT NULL AND NOT (try_cast(UnitPrice AS DOUBLE) > 0)) FROM dirty
  UNION ALL SELECT 'CustomerID', 'numeric', count(CustomerID),
    count(*) FILTER (WHERE CustomerID IS NOT NULL AND try_cast(CustomerID AS DOUBLE) IS NULL) FROM dirty
  UNION ALL SELECT 'InvoiceDate', 'date', count(InvoiceDate),
    count(*) FILTER (WHERE InvoiceDate IS NOT NULL AND try_strptime(InvoiceDate, {LOADER_FORMATS_SQL}) IS NULL) FROM dirty
) t"""))

