"""Column-level helpers: every function returns a Spark ``Column`` (JVM-side, codegen-able)."""

from tillroll.functions.columns import (  # noqa: F401
    as_count, fmt_currency, fmt_label, fmt_number, money, ratio, safe_div, sanitize_text,
    strip_ws, title_case,
)
