"""Validation: checks return rows (level, code, count, message), not exceptions.

All row-level checks of a table are computed by a single aggregate pass; only the
duplicate count needs a second (shuffling) aggregate. The schema check runs on the plan.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import ratio
from tillroll.schema import DATE_FORMATS, EMAIL_PATTERN, NUMERIC_COLUMNS, REQUIRED_COLUMNS


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """V2: each required column with ``present`` (schema only, no scan)."""
    have = set(df.columns)
    rows = [(c, c in have) for c in required]
    return df.sparkSession.createDataFrame(rows, "column string, present boolean")


def _num(col: str) -> Column:
    return F.col(col).try_cast(T.DoubleType())


def checks(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """V1, V3-V7 in one aggregate: one row of counts per ``by`` group."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in NUMERIC_COLUMNS:
        if c in df.columns:
            aggs += [F.count(F.col(c)).alias(f"{c}_present"),
                     F.count_if(F.col(c).isNotNull() & _num(c).isNull()).alias(f"{c}_non_numeric"),
                     F.count_if(_num(c) < 0).alias(f"{c}_negative")]
    if "InvoiceDate" in df.columns:
        aggs.append(F.count(F.col("InvoiceDate")).alias("InvoiceDate_present"))
    return df.groupBy(*by).agg(*aggs)


def duplicate_rows(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """V5: repeated full rows = rows - distinct rows (copies collapse map-side)."""
    per = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*by).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def report(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS, by: Sequence[str] = ()) -> DataFrame:
    """V8: every failing check as (by..., level, code, count, message); a group is valid if it has no error.

    Level 'error': empty table, missing columns, all-null numeric/date column, negative
    price. Level 'warning': non-numeric values, duplicate rows, negative quantities.
    An empty table reports only 'empty', like the studied validator; a group always has rows. All checks are columns
    of one row per group, which ``inline`` turns into rows: the input is read once for the checks and once for the
    duplicates.
    """
    by = list(by)
    c, dup = checks(df, by), duplicate_rows(df, by)
    if by:
        dup = dup.select(*[F.col(k).alias(f"_{k}") for k in by], "duplicate_rows")
        cond = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
        c = c.join(dup, cond, "left").drop(*[f"_{k}" for k in by])
    else:
        c = c.crossJoin(F.broadcast(dup))
    missing = [m for m in required if m not in df.columns]
    items = []

    def item(level: str, code: str, count: Column, message: Column, cond: Column) -> None:
        items.append(F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"),
                                           count.cast("bigint").alias("count"), message.alias("message"))))

    def found(what: str, column: str) -> Column:
        return F.format_string(f"Found %d {what}", F.col(column))

    some = F.col("rows") > 0
    item("error", "empty", F.lit(0), F.lit("File contains no data"), ~some)
    if missing:
        msg = "Missing required columns: [" + ", ".join(f"'{m}'" for m in sorted(missing)) + "]"
        item("error", "missing_columns", F.lit(len(missing)), F.lit(msg), some)
    for col in NUMERIC_COLUMNS:
        if col in df.columns:
            present = F.col(f"{col}_present") > 0
            item("error", f"{col}_all_null", F.col("rows"), F.lit(f"Column '{col}' is completely empty"), some & ~present)
            item("warning", f"{col}_non_numeric", F.col(f"{col}_non_numeric"), F.lit(f"Column '{col}' is not numeric type"),
                 some & present & (F.col(f"{col}_non_numeric") > 0))
    if "InvoiceDate" in df.columns:
        item("error", "InvoiceDate_all_null", F.col("rows"), F.lit("InvoiceDate column is completely empty"),
             some & (F.col("InvoiceDate_present") == 0))
    item("warning", "duplicate_rows", F.col("duplicate_rows"), found("duplicate rows", "duplicate_rows"),
         some & (F.col("duplicate_rows") > 0))
    if "Quantity" in df.columns:
        item("warning", "negative_quantity", F.col("Quantity_negative"), found("rows with negative quantities", "Quantity_negative"),
             some & (F.col("Quantity_negative") > 0))
    if "UnitPrice" in df.columns:
        item("error", "negative_price", F.col("UnitPrice_negative"), found("rows with negative prices", "UnitPrice_negative"),
             some & (F.col("UnitPrice_negative") > 0))
    return c.select(*by, F.inline(F.array_compact(F.array(*items))))


def is_valid(report_df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``is_valid`` = the report holds no error: one row, or one per group that is in the report."""
    return report_df.groupBy(*by).agg((F.count_if(F.col("level") == "error") == 0).alias("is_valid"))


def rejected(report_df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The groups that have an error, with their messages in the order of their codes."""
    return (report_df.where("level = 'error'").groupBy(*by)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "message"))), lambda e: e["message"]).alias("errors")))


# --------------------------------------------------------------- value rules over tables
def email_ok(col: Column) -> Column:
    return col.rlike(EMAIL_PATTERN)


def date_ok(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """True when the text parses with one of the formats (whole value)."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats]).isNotNull()


def numeric_ok(col: Column) -> Column:
    return col.try_cast(T.DoubleType()).isNotNull()


def email_candidates(df: DataFrame, text_col: str, by: Sequence[str] = ()) -> DataFrame:
    """V9: tokens containing '@' in whole texts, checked against the e-mail pattern.

    Only the tokens with an '@' are exploded, so the row count grows with addresses, not
    with words.
    """
    toks = df.select(*by, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(\S*@\S*)"), 1)).alias("_t"))
    return toks.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("candidates"),
                                 F.count_if(email_ok(F.col("_t"))).cast("bigint").alias("valid"),
                                 F.count_if(~email_ok(F.col("_t"))).cast("bigint").alias("invalid"))


def date_failures(df: DataFrame, col: str, by: Sequence[str] = (), formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Non-null values matching none of the date formats, per group."""
    v = F.col(col).cast("string")
    return df.groupBy(*by).agg(F.count(v).cast("bigint").alias("checked"),
                               F.count_if(v.isNotNull() & ~date_ok(v, formats)).cast("bigint").alias("failures"))


def profile_rules(df: DataFrame, rules: Sequence[tuple[str, str]], by: Sequence[str] = (),
                  formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """One row per (column, rule) with checked values, failures and failure rate (%).

    Rules: 'numeric', 'positive' (> 0 where numeric), 'email', 'date'. One aggregate pass
    computes every pair; the result is unpivoted with ``stack``.
    """
    aggs, names = [], []
    for i, (col, rule) in enumerate(rules):
        v = F.col(col).cast("string")
        fail = {"numeric": ~numeric_ok(v),
                "positive": numeric_ok(v) & ~(v.try_cast(T.DoubleType()) > 0),
                "email": ~email_ok(v),
                "date": ~date_ok(v, formats)}[rule]
        aggs += [F.count(v).alias(f"c{i}"), F.count_if(v.isNotNull() & fail).alias(f"f{i}")]
        names.append((col, rule, f"c{i}", f"f{i}"))
    wide = df.groupBy(*by).agg(*aggs)
    stack = "stack({}, {}) as (column, rule, checked, failures)".format(
        len(names), ", ".join(f"'{c}', '{r}', {ck}, {fl}" for c, r, ck, fl in names))
    out = wide.selectExpr(*by, stack)
    return out.select(*by, "column", "rule", F.col("checked").cast("bigint").alias("checked"),
                      F.col("failures").cast("bigint").alias("failures"),
                      ratio(F.coalesce(F.try_divide(F.col("failures") * 100.0, F.col("checked")), F.lit(0.0))).alias("failure_pct"))
