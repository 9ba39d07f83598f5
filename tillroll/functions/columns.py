"""Scalar column expressions. No Python UDFs: all of these stay inside whole-stage codegen."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_div(num, den) -> Column:
    """NULL instead of an ANSI divide-by-zero error."""
    return F.try_divide(_c(num), _c(den))


def money(col) -> Column:
    """Exact decimal money value -> DOUBLE with 2 digits (output only)."""
    return F.round(_c(col), 2).cast(T.DoubleType())


def dround(col, digits: int) -> Column:
    """Round a DOUBLE on its binary value: ``round(x * 10^d) / 10^d``.

    Spark's ``round`` on doubles rounds the shortest decimal text (146651.82875 -> .8288)
    although the binary value is below the half (146651.828749...); this form rounds the
    value itself, like Python and DuckDB do, so a mean of cents like s / 8 rounds the same
    way everywhere.
    """
    scale = float(10 ** digits)
    return F.round(_c(col).cast(T.DoubleType()) * scale, 0) / scale


def ratio(col, digits: int = 4) -> Column:
    """Means, percentiles, rates: rounded to ``digits`` (see :func:`dround`), DOUBLE."""
    return dround(col, digits)


def once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows, with ``columns`` worked out once per row: filters over them are not pushed below this place, where each
    would repeat the expressions it names."""
    item = F.explode(F.array(F.struct(*[F.col(c) for c in columns]))).alias("_once")
    return (df.select(*[c for c in df.columns if c not in columns], item)
            .select(*[F.col("_once")[c].alias(c) if c in columns else F.col(c) for c in df.columns]))


def as_count(col) -> Column:
    return _c(col).cast(T.LongType())


def strip_ws(col) -> Column:
    """Remove leading and trailing whitespace of any kind (not just blanks). A plain trim, except before a last line
    separator outside ASCII, which ends a text for ``$``."""
    c = _c(col)
    odd = F.endswith(c, F.lit("\u0085")) | F.endswith(c, F.lit("\u2028")) | F.endswith(c, F.lit("\u2029"))
    return F.when(odd, F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(F.btrim(c, F.lit(" \t\n\x0b\f\r")))


def title_case(col) -> Column:
    """Title case that restarts after every non-letter (``u.s.a`` -> ``U.S.A``).

    ``initcap`` only restarts after white space, so the text is cut into runs of letters
    and non-letters, each run is capitalised, and the runs are joined again. Texts of ASCII letters
    and blanks, where both are the same, take ``initcap``.
    """
    runs = F.regexp_extract_all(_c(col), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.when(_c(col).isNull(), None).when(_c(col).rlike("^[A-Za-z ]*\\z"), F.initcap(_c(col))).otherwise(
        F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                           F.lower(F.substring(r, 2, 1 << 30)))), ""))


def sanitize_text(col) -> Column:
    """Drop control characters first (so tab/newline vanish), trim, squeeze white space."""
    no_ctrl = F.regexp_replace(F.coalesce(_c(col).cast("string"), F.lit("")), r"[\x00-\x1f\x7f]", "")
    return F.regexp_replace(strip_ws(no_ctrl), r"\s+", " ")


def fmt_currency(col) -> Column:
    """``$1,234.50``; NULL -> ``$0.00``; negative -> ``$-12.00``."""
    return F.concat(F.lit("$"), F.format_number(F.coalesce(_c(col).cast("double"), F.lit(0.0)), 2))


def fmt_number(col) -> Column:
    """Thousands separators after truncation toward zero; NULL -> ``0``."""
    return F.coalesce(F.format_number(_c(col).cast("double").cast("bigint"), 0), F.lit("0"))


def fmt_label(col, width: int = 30, default: str = "") -> Column:
    """Cut to ``width`` characters plus ``...`` when longer; NULL -> ``default``."""
    s = F.coalesce(_c(col).cast("string"), F.lit(default))
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))).otherwise(s)
