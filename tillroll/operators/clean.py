"""Cleaning: missing values, types, invalid rows, text, revenue, dates, flags, duplicates.

Every step is a lazy ``DataFrame -> DataFrame`` transformation; ``clean`` chains them. Steps
skip themselves when their columns are absent (the schema is known at plan time). Report
operators return rows ``(step, stat, value)`` or small typed tables, computed with one
aggregate per stage instead of one scan per statistic.

Deliberate deviations from the studied application:
* null ``InvoiceNo``/``StockCode`` stay NULL (it turned them into the text ``'None'``);
* exact duplicates are removed over the input columns before the derived columns are
  added; derived columns are functions of those and of the thresholds taken before the
  removal, so the surviving rows are the same, and the shuffle carries fewer columns.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import dround, once, strip_ws, title_case
from tillroll.functions.dates import parse_dates, strict_dates
from tillroll.plans.groups import attach
from tillroll.plans.quantiles import percentiles, percentiles_of
from tillroll.schema import (
    EXTREME_FACTOR, EXTREME_QUANTILE, FLAG_EXTREME_PRICE, FLAG_EXTREME_QTY, PRICE_TYPE,
    QTY_DECIMAL, QUALITY_PENALTY, SUSPICIOUS_MIN_ROWS, UNKNOWN_COUNTRY, UNKNOWN_CUSTOMER,
    UNKNOWN_PRODUCT, VALUE_TYPE,
)
from tillroll.session import store

FILLED = ("CustomerID", "Description", "Country", "Quantity", "UnitPrice")
REASONS = ("invalid_dates", "invalid_prices", "zero_quantity", "out_of_range")
# Rows beyond these limits are removed under their own reason: values are summed as DECIMAL(38,6), which
# holds 10^12 of the largest ones.
QTY_LIMIT, VALUE_LIMIT = 1e12, 1e20
HOT_PAIRS = 1000

DERIVED_COLUMNS = ["TransactionValue", "IsReturn", "SalesRevenue", "ReturnsValue", "NetRevenue",
                   "Revenue", "Year", "Month", "MonthName", "Quarter", "Weekday", "DayOfMonth",
                   "Hour", "Date", "TransactionRef", "DataQualityScore", "QualityFlag", "NeedsReview"]


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def _zero_like(df: DataFrame, col: str) -> Column:
    dtype = df.schema[col].dataType
    return F.lit("0") if isinstance(dtype, T.StringType) else F.lit(0).cast(dtype)


# ------------------------------------------------------------------ C1 / C2: missing values
def fill_constants(df: DataFrame) -> DataFrame:
    """CustomerID -> 'Unknown', Description -> 'Unknown Product', numbers -> 0."""
    cols = {}
    if _has(df, "CustomerID"):
        cols["CustomerID"] = F.coalesce(F.col("CustomerID"), F.lit(UNKNOWN_CUSTOMER))
    if _has(df, "Description"):
        cols["Description"] = F.coalesce(F.col("Description"), F.lit(UNKNOWN_PRODUCT))
    for c in ("Quantity", "UnitPrice"):
        if _has(df, c):
            cols[c] = F.coalesce(F.col(c), _zero_like(df, c))
    return df.withColumns(cols) if cols else df


def country_mode(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null Country per group (ties -> smallest value): counts per value, then the best of the
    counts, so that no task holds all values of a group."""
    counts = df.where(F.col("Country").isNotNull()).groupBy(*by, "Country").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min(F.struct(-F.col("_n"), "Country"))["Country"].alias("_country_mode"))


def fill_mode(df: DataFrame, by: Sequence[str] = (), mode: DataFrame | None = None) -> DataFrame:
    """Null Country -> the group's most frequent Country, 'Unknown' if it has none. ``mode`` may pass the
    modes if they are known (one row per group)."""
    if not _has(df, "Country"):
        return df
    out = attach(df, country_mode(df, by) if mode is None else mode, by)
    return (out.withColumn("Country", F.coalesce(F.col("Country"), F.col("_country_mode"),
                                                 F.lit(UNKNOWN_COUNTRY)))
            .drop("_country_mode"))


def fill_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Filled cells per column, as rows (by..., column, filled); zero counts omitted."""
    cols = [c for c in ("CustomerID", "Description", "Country", "Quantity", "UnitPrice") if _has(df, c)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, filled bigint")
    wide = df.groupBy(*by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = "stack({n}, {pairs}) as (column, filled)".format(
        n=len(cols), pairs=", ".join(f"'{c}', `{c}`" for c in cols))
    return wide.selectExpr(*by, stack).where(F.col("filled") > 0)


# ------------------------------------------------------------------ C4: types
def cast_types(df: DataFrame, date_formats: Sequence[str] | None = None) -> DataFrame:
    """C4: ids and country -> text, numbers -> DOUBLE / DECIMAL(22,6) with bad -> 0, dates -> TIMESTAMP_NTZ with
    bad -> NULL. Dates are read by the shape of their text, or by strict ``date_formats`` if some are given."""
    cols = {}
    for c in ("InvoiceNo", "StockCode", "CustomerID", "Country"):
        if _has(df, c):
            cols[c] = F.col(c).cast("string")
    if _has(df, "Quantity"):
        q = F.col("Quantity").try_cast(T.DoubleType())
        # NaN and infinities are bad numbers like any other text
        cols["Quantity"] = F.when(F.abs(q) < float("inf"), q).otherwise(F.lit(0.0))
    if _has(df, "UnitPrice"):
        cols["UnitPrice"] = F.coalesce(F.col("UnitPrice").try_cast(PRICE_TYPE), F.lit(0).cast(PRICE_TYPE))
    if _has(df, "InvoiceDate"):
        dtype = df.schema["InvoiceDate"].dataType
        if isinstance(dtype, T.StringType):
            cols["InvoiceDate"] = (parse_dates(F.col("InvoiceDate")) if date_formats is None
                                   else strict_dates(F.col("InvoiceDate"), date_formats))
        else:
            cols["InvoiceDate"] = F.col("InvoiceDate").cast(T.TimestampNTZType())
    return df.withColumns(cols) if cols else df


# ------------------------------------------------------------------ C5 / C6: invalid rows
def removal_reason(df: DataFrame) -> Column:
    """First failing rule wins: invalid date, then price <= 0, then zero quantity, then a quantity or value beyond the
    range of exact sums (``QTY_LIMIT``, ``VALUE_LIMIT``)."""
    reason = F.lit(None).cast("string")
    chain = None
    rules = []
    if _has(df, "InvoiceDate"):
        rules.append((F.col("InvoiceDate").isNull(), "invalid_dates"))
    if _has(df, "UnitPrice"):
        rules.append((F.col("UnitPrice") <= 0, "invalid_prices"))
    if _has(df, "Quantity"):
        rules.append((F.col("Quantity") == 0, "zero_quantity"))
        rules.append((out_of_range(df), "out_of_range"))
    for cond, name in rules:
        chain = F.when(cond, F.lit(name)) if chain is None else chain.when(cond, F.lit(name))
    return chain if chain is not None else reason


def out_of_range(df: DataFrame) -> Column:
    size = F.abs(F.col("Quantity").cast("double"))
    big = size >= QTY_LIMIT
    return big | (size * F.col("UnitPrice").cast("double") >= VALUE_LIMIT) if _has(df, "UnitPrice") else big


def filter_invalid(df: DataFrame) -> DataFrame:
    """Drop rows without a date, with price <= 0, with quantity 0 or out of range (one pushed filter)."""
    conds = []
    if _has(df, "InvoiceDate"):
        conds.append(F.col("InvoiceDate").isNotNull())
    if _has(df, "UnitPrice"):
        conds.append(F.col("UnitPrice") > 0)
    if _has(df, "Quantity"):
        conds += [F.col("Quantity") != 0, ~out_of_range(df)]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def removal_report(typed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Removed rows per reason (non-zero only) plus ``total_removed``, per group."""
    reasons = REASONS
    r = removal_reason(typed)
    wide = typed.groupBy(*by).agg(*[F.count_if(r == F.lit(n)).alias(n) for n in reasons],
                                  F.count_if(r.isNotNull()).alias("total_removed"))
    stack = "stack({}, {}) as (reason, removed)".format(
        len(reasons) + 1, ", ".join(f"'{n}', `{n}`" for n in (*reasons, "total_removed")))
    return (wide.selectExpr(*by, stack)
            .where((F.col("removed") > 0) | (F.col("reason") == "total_removed")))


# ------------------------------------------------------------------ C7: text
def standardize_text(df: DataFrame) -> DataFrame:
    """Country stripped and title-cased, Description stripped."""
    cols = {}
    if _has(df, "Country"):
        cols["Country"] = title_case(strip_ws(F.col("Country")))
    if _has(df, "Description"):
        cols["Description"] = strip_ws(F.col("Description"))
    return df.withColumns(cols) if cols else df


# ------------------------------------------------------------------ C8 / C9: revenue
def transaction_value() -> Column:
    """Quantity x price as DECIMAL(38,6); 0 for quantities out of range, whose rows :func:`filter_invalid` removes."""
    q = F.coalesce(F.col("Quantity").try_cast(QTY_DECIMAL), F.lit(0).cast(QTY_DECIMAL))
    return (q * F.col("UnitPrice").cast(PRICE_TYPE)).cast(VALUE_TYPE)


def revenue_columns(df: DataFrame) -> DataFrame:
    """Decimal transaction value, sales, returns and net revenue per row."""
    if not _has(df, "Quantity", "UnitPrice"):
        return df
    q = F.col("Quantity")
    tv = transaction_value()
    zero = F.lit(0).cast(VALUE_TYPE)
    return (df.withColumn("TransactionValue", tv)
            .withColumn("IsReturn", q < 0)
            .withColumn("SalesRevenue", F.when(q > 0, F.col("TransactionValue")).otherwise(zero))
            .withColumn("ReturnsValue", F.when(q < 0, F.abs(F.col("TransactionValue"))).otherwise(zero))
            .withColumn("NetRevenue", F.col("SalesRevenue") - F.col("ReturnsValue"))
            .withColumn("Revenue", F.col("NetRevenue")))


def return_rate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gross sales, returns, net revenue and return rate % (0 when no sales)."""
    d = df if _has(df, "SalesRevenue") else revenue_columns(df)
    agg = d.groupBy(*by).agg(F.sum("SalesRevenue").alias("gs"), F.sum("ReturnsValue").alias("tr"))
    rate = F.coalesce(F.when(F.col("gs") > 0, F.col("tr").cast("double") / F.col("gs").cast("double") * 100),
                      F.lit(0.0))
    return agg.select(*by,
                      F.round(F.col("gs"), 2).cast("double").alias("gross_sales"),
                      F.round(F.col("tr"), 2).cast("double").alias("total_returns"),
                      F.round(F.col("gs") - F.col("tr"), 2).cast("double").alias("net_revenue"),
                      dround(rate, 2).alias("return_rate"))


# ------------------------------------------------------------------ C10 / C11: parts, ref
def date_parts(df: DataFrame) -> DataFrame:
    """Year, Month, MonthName, Quarter, Weekday, DayOfMonth, Hour, Date."""
    if not _has(df, "InvoiceDate"):
        return df
    ts = F.col("InvoiceDate")
    return df.withColumns({
        "Year": F.year(ts), "Month": F.month(ts), "MonthName": F.date_format(ts, "MMMM"),
        "Quarter": F.quarter(ts), "Weekday": F.date_format(ts, "EEEE"),
        "DayOfMonth": F.dayofmonth(ts), "Hour": F.hour(ts), "Date": F.to_date(ts),
    })


def transaction_ref(df: DataFrame) -> DataFrame:
    """C11: ``InvoiceNo_StockCode`` (NULL when either part is NULL); reference only."""
    if not _has(df, "InvoiceNo", "StockCode"):
        return df
    return df.withColumn("TransactionRef", F.concat(F.col("InvoiceNo"), F.lit("_"), F.col("StockCode")))


# ------------------------------------------------------------------ C12: quality flags
def quality_thresholds(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """q99 of Quantity and UnitPrice per group (exact, linear interpolation)."""
    return percentiles_of(df, {"Quantity": {"_q99_qty": EXTREME_QUANTILE}, "UnitPrice": {"_q99_price": EXTREME_QUANTILE}}, by)


def apply_quality_flags(df: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    x = attach(df, thresholds, by)
    qf = F.coalesce(F.col("Quantity") > F.col("_q99_qty") * EXTREME_FACTOR, F.lit(False))
    pf = F.coalesce(F.col("UnitPrice").cast("double") > F.col("_q99_price") * EXTREME_FACTOR, F.lit(False))
    score = (F.lit(1.0) * F.when(qf, F.lit(QUALITY_PENALTY)).otherwise(F.lit(1.0))
             * F.when(pf, F.lit(QUALITY_PENALTY)).otherwise(F.lit(1.0)))
    flag = F.when(pf, F.lit(FLAG_EXTREME_PRICE)).when(qf, F.lit(FLAG_EXTREME_QTY))
    return (x.withColumn("DataQualityScore", score).withColumn("QualityFlag", flag)
            .drop("_q99_qty", "_q99_price"))


def quality_flags(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Value > 3 x q99 is extreme; score x0.7 per flag, price flag overrides quantity."""
    if not _has(df, "Quantity", "UnitPrice"):
        return df.withColumn("DataQualityScore", F.lit(1.0))
    rows = store(df, "flag-rows")  # read for the thresholds and again to be flagged
    return apply_quality_flags(rows, quality_thresholds(rows, by), by)


# ------------------------------------------------------------------ C13-C15: duplicates
def dedup(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop exact duplicate rows (partial aggregation collapses copies map-side)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def multi_entries(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """C14: invoice-product pairs occurring more than once: pair count and their rows."""
    pairs = (df.groupBy(*by, "InvoiceNo", "StockCode").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > 1))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("legitimate_multiple_entries"),
                                  F.sum("n").cast("bigint").alias("total_multiple_entry_rows"))


def suspicious(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """NeedsReview = true where an invoice of one ``by`` group has more than 3 rows in one
    minute, else NULL.

    The rows are stored, as they are read for the counts and marked after them. Pairs (invoice, minute) are counted with a
    partial aggregate; the flagged ones are stored and joined back. Pairs with a
    thousandth of all flagged rows or more, of which there are a thousand at most, are broadcast; their rows take no part
    in the other join (a hash of the row stands in for their key there), so that no task gets a pair that holds a third of
    the rows.
    """
    if not _has(df, "InvoiceNo", "InvoiceDate"):
        return df
    d = store(df, "clean-rows").withColumn("_minute", F.date_trunc("minute", F.col("InvoiceDate")))
    keys = [*by, "InvoiceNo", "_minute"]
    counts = d.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    flagged = store(counts.where(F.col("_n") > SUSPICIOUS_MIN_ROWS), "suspicious-pairs")
    large = F.col("_n") * HOT_PAIRS >= F.col("_all")
    marked = flagged.crossJoin(F.broadcast(flagged.agg(F.sum("_n").alias("_all"))))
    hot = marked.where(large).select(*keys, F.lit(True).alias("_hot"))
    rest = marked.where(~large).select(*keys, F.lit(0).cast("bigint").alias("_stand_in"), F.lit(True).alias("_cold"))
    d = d.join(F.broadcast(hot), on=keys, how="left")
    d = d.withColumn("_stand_in", F.when(F.col("_hot"), F.xxhash64(*df.columns).bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("bigint"))
    out = d.join(rest, on=[*keys, "_stand_in"], how="left")
    return out.select(*df.columns, F.when(F.col("_hot") | F.col("_cold"), F.lit(True)).alias("NeedsReview"))


# ------------------------------------------------------------------ C17: the whole chain
def prepare(df: DataFrame, by: Sequence[str] = (), date_formats: Sequence[str] | None = None,
            mode: DataFrame | None = None) -> DataFrame:
    """Fill and type, before any row is removed."""
    return cast_types(fill_mode(fill_constants(df), by, mode), date_formats)


def valid_rows(df: DataFrame, by: Sequence[str] = (), date_formats: Sequence[str] | None = None,
               mode: DataFrame | None = None) -> DataFrame:
    """Filled, typed, filtered and standardised rows (duplicates still present)."""
    typed = prepare(df, by, date_formats, mode)
    tested = [c for c in ("InvoiceDate", "UnitPrice", "Quantity") if _has(typed, c)]
    return standardize_text(filter_invalid(once(typed, tested) if tested else typed))


class RawProfile:
    """One pass over raw rows: how often each country, valid quantity and valid price occurs per ``by`` group, and the
    counters of every cleaning step. It is stored in the shared checkpoint folder; the modes, the thresholds and the
    report of the cleaning come from it, so that the chain itself reads the rows once more and no report reads them."""

    def __init__(self, raw: DataFrame, by: Sequence[str] = (), date_formats: Sequence[str] | None = None):
        self.by, self.date_formats = list(by), date_formats
        self.raw_columns = raw.columns
        self.fill_columns = [c for c in FILLED if c in raw.columns]
        typed = cast_types(fill_constants(raw.withColumns({f"_null_{c}": F.col(c).isNull() for c in self.fill_columns})
                                          .withColumn("_country", F.col("Country").cast("string") if "Country" in raw.columns
                                                      else F.lit(None).cast("string"))), date_formats)
        typed = typed.withColumn("_reason", removal_reason(typed))
        ok = F.col("_reason").isNull()
        self.numbers = [c for c in ("Quantity", "UnitPrice") if c in raw.columns]
        nothing = F.lit(None).cast("double")
        items = [F.struct(F.lit("Country").alias("kind"), F.col("_country").alias("text"), nothing.alias("number"))]
        items += [F.when(ok, F.struct(F.lit(c).alias("kind"), F.lit(None).cast("string").alias("text"),
                                      F.col(c).cast("double").alias("number"))) for c in self.numbers]
        own = F.col("_item.kind") == "Country"
        self.counters = {f"{c}_filled": F.col(f"_null_{c}") for c in self.fill_columns}
        if "InvoiceDate" in raw.columns:
            self.counters["invalid_dates_found"] = F.col("InvoiceDate").isNull()
        self.counters |= {r: F.col("_reason") == r for r in REASONS} | {"valid_rows": ok}
        money_columns = []
        if len(self.numbers) == 2:
            value = transaction_value()
            money_columns = [F.sum(F.when(own & ok & (F.col("Quantity") > 0), value)).alias("sales"),
                             F.sum(F.when(own & ok & (F.col("Quantity") < 0), -value)).alias("returns")]
        self.money = bool(money_columns)
        rows = typed.select("*", F.explode(F.array_compact(F.array(*items))).alias("_item"))
        counted = rows.groupBy(*self.by, F.col("_item.kind").alias("kind"), F.col("_item.text").alias("text"),
                               F.col("_item.number").alias("number")).agg(
            F.count(F.lit(1)).alias("n"), *[F.count_if(own & c).alias(name) for name, c in self.counters.items()], *money_columns)
        self.table = store(counted, "raw-profile", partition_by=["kind"])

    def _kind(self, *kinds: str) -> DataFrame:
        return self.table.where(F.col("kind").isin(*kinds))

    def mode(self) -> DataFrame:
        """Country modes, as :func:`country_mode`."""
        return (self._kind("Country").where("text IS NOT NULL").groupBy(*self.by)
                .agg(F.min(F.struct(-F.col("n"), "text"))["text"].alias("_country_mode")))

    def thresholds(self) -> DataFrame:
        """q99 of quantity and price, as :func:`quality_thresholds`."""
        q = percentiles(self._kind(*self.numbers), "number", [EXTREME_QUANTILE], [*self.by, "kind"], names=["_q"], weight="n")
        return q.groupBy(*self.by).agg(F.max(F.when(F.col("kind") == "Quantity", F.col("_q"))).alias("_q99_qty"),
                                       F.max(F.when(F.col("kind") == "UnitPrice", F.col("_q"))).alias("_q99_price"))

    def counts(self) -> DataFrame:
        """One row per group: ``original_rows``, the counters and the sums ``sales`` and ``returns`` of the valid rows."""
        sums = [F.sum(c) for c in ("sales", "returns")] if self.money else [F.lit(None).cast(VALUE_TYPE)] * 2
        return self._kind("Country").groupBy(*self.by).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("original_rows"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self.counters], sums[0].alias("sales"), sums[1].alias("returns"))


def clean(df: DataFrame, by: Sequence[str] = (), date_formats: Sequence[str] | None = None,
          profile: RawProfile | None = None) -> DataFrame:
    """C17: the whole cleaning chain. The raw rows are read twice: for the profile (made here if none is passed) and for
    the chain, which stores its de-duplicated rows once.

    Order of the studied application: fill -> types -> invalid rows -> text -> derived
    columns -> quality flags (thresholds over the rows before de-duplication) -> exact
    de-duplication -> suspicious clusters. Here clusters are marked on the narrow rows, before the derived columns.
    """
    profile = profile or RawProfile(df, by, date_formats)
    out = suspicious(dedup(valid_rows(df, by, date_formats, profile.mode())), by)
    out = transaction_ref(date_parts(revenue_columns(out)))
    if _has(out, "Quantity", "UnitPrice"):
        out = apply_quality_flags(out, profile.thresholds(), by)
    else:
        out = out.withColumn("DataQualityScore", F.lit(1.0)).withColumn("QualityFlag", F.lit(None).cast("string"))
    if "NeedsReview" in out.columns:
        out = out.select(*[c for c in out.columns if c != "NeedsReview"], "NeedsReview")
    return out


def sanitize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Control characters removed, trimmed, white space squeezed, in the given columns."""
    from tillroll.functions.columns import sanitize_text
    return df.withColumns({c: sanitize_text(F.col(c)) for c in columns})
