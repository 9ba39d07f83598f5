"""The cleaning report as rows (by..., step, stat, value), of one business or of many.

The studied cleaner re-scanned the table for every statistic. Here the counters of the steps up to the removal of
invalid rows come from the stored profile of the raw rows, which the cleaning needs anyway, and those of the
de-duplication from one aggregate over the de-duplicated rows: two passes over the raw rows in all.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import dround, safe_div
from tillroll.operators import clean as C
from tillroll.schema import SUSPICIOUS_MIN_ROWS


def duplicate_counts(deduped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``final_rows``, pairs (invoice, product) that occur more than once with their rows, and rows in suspicious clusters,
    in one pass: every row counts once under its pair and once under its minute, both pre-aggregated per task."""
    minute = F.date_trunc("minute", F.col("InvoiceDate")).cast("string")
    none = F.lit(None).cast("string")
    items = F.array(F.struct(F.lit(True).alias("pair"), "InvoiceNo", F.col("StockCode").alias("part")),
                    F.struct(F.lit(False).alias("pair"), "InvoiceNo", F.coalesce(minute, none).alias("part")))
    per = deduped.select(*by, F.inline(items)).groupBy(*by, "pair", "InvoiceNo", "part").agg(F.count(F.lit(1)).alias("n"))
    several = F.col("pair") & (F.col("n") > 1)
    cluster = ~F.col("pair") & F.col("InvoiceNo").isNotNull() & (F.col("n") > SUSPICIOUS_MIN_ROWS)
    for k in by:  # clusters are marked by an equi-join, which null keys do not meet
        cluster = cluster & F.col(k).isNotNull()
    return per.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("pair"), F.col("n"))), F.lit(0)).alias("final_rows"),
        F.count_if(several).alias("legitimate_multiple_entries"),
        F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("total_multiple_entry_rows"),
        F.coalesce(F.sum(F.when(cluster, F.col("n"))), F.lit(0)).alias("suspicious_transactions_for_review"))


def clean_report(raw: DataFrame, by: Sequence[str] = (), date_formats: Sequence[str] | None = None,
                 profile: C.RawProfile | None = None, cleaned: DataFrame | None = None) -> DataFrame:
    """``profile`` and ``cleaned`` may pass what a run has made already; then the raw rows are not read at all."""
    by = list(by)
    p = profile or C.RawProfile(raw, by, date_formats)
    w = p.counts()
    ends = duplicate_counts(C.dedup(C.valid_rows(raw, by, date_formats, p.mode())) if cleaned is None else cleaned, by)
    if by:
        other = ends.select(*[F.col(k).alias(f"_{k}") for k in by], *[c for c in ends.columns if c not in by])
        cond = F.lit(True)
        for k in by:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
        w = w.join(other, cond, "left").drop(*[f"_{k}" for k in by])
    else:
        w = w.crossJoin(F.broadcast(ends))
    final_columns = len(set(raw.columns) | set(C.DERIVED_COLUMNS))

    def d(x):
        return F.coalesce((F.col(x) if isinstance(x, str) else x), F.lit(0)).cast(T.DoubleType())

    gs, tr = F.coalesce("sales", F.lit(0)), F.coalesce("returns", F.lit(0))
    rate = F.coalesce(F.when(gs > 0, tr.cast("double") / gs.cast("double") * 100), F.lit(0.0))
    removed = d("valid_rows") - d("final_rows")
    stats = [("missing_value_handling", f"{c}_filled", d(f"{c}_filled"), True) for c in p.fill_columns]
    stats += [("type_conversion", "invalid_dates_found", d("invalid_dates_found"), True)] if "invalid_dates_found" in p.counters else []
    stats += [("invalid_row_removal", r, d(r), True) for r in C.REASONS]
    stats += [
        ("invalid_row_removal", "total_removed", d("original_rows") - d("valid_rows"), False),
        ("derived_columns", "gross_sales", d(F.round(gs, 2)), False),
        ("derived_columns", "total_returns", d(F.round(tr, 2)), False),
        ("derived_columns", "net_revenue", d(F.round(gs - tr, 2)), False),
        ("derived_columns", "return_rate", dround(rate, 2), False),
        ("duplicate_removal", "exact_duplicates_removed", removed, True),
        ("duplicate_removal", "legitimate_multiple_entries", d("legitimate_multiple_entries"), True),
        ("duplicate_removal", "total_multiple_entry_rows", d("total_multiple_entry_rows"), True),
        ("duplicate_removal", "suspicious_transactions_for_review", d("suspicious_transactions_for_review"), True),
        ("duplicate_removal", "final_rows", d("final_rows"), False),
        ("duplicate_removal", "rows_removed", removed, False),
        ("duplicate_removal", "removal_rate", dround(safe_div(removed, d("valid_rows")) * 100, 2), False),
        ("summary", "original_rows", d("original_rows"), False),
        ("summary", "original_columns", F.lit(float(len(raw.columns) - len(by))), False),
        ("summary", "final_rows", d("final_rows"), False),
        ("summary", "final_columns", F.lit(float(final_columns - len(by))), False),
        ("summary", "rows_removed", d("original_rows") - d("final_rows"), False),
        ("summary", "rows_removed_percentage", dround((1 - safe_div(d("final_rows"), d("original_rows"))) * 100, 2), False),
    ]
    arr = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(n).alias("stat"), v.alias("value"),
                             F.lit(only_pos).alias("_pos")) for s, n, v, only_pos in stats])
    out = w.select(*by, F.inline(arr))
    return out.where(~F.col("_pos") | (F.col("value") > 0)).drop("_pos")
