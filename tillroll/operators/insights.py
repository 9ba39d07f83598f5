"""Rule-based insights per business, as rows. Rules are column expressions over the metrics
row of each business: ``inline(filter(array(when(rule, struct(...)))))`` emits the rows whose
rule holds, for every business in one pass (no driver loop, no Python UDF).

Numbers are rounded explicitly before they are formatted, so the text does not depend on
the rounding mode of the formatter. A NULL month-over-month growth gives no growth
insight and counts as 0 in the summary sentence (the studied code raised an error there).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import dround, fmt_label
from tillroll.operators import kpi as K
from tillroll.operators.health import join_one, metrics_row, with_health
from tillroll.plans.grains import Grains
from tillroll.schema import MIN_INVOICES_FOR_AI, SEGMENTS

# ---------------------------------------------------------------------------------------
# Wording, thresholds and confidences of the studied rule set
# ---------------------------------------------------------------------------------------
FALLBACK_INSIGHT = ("Data Analysis Complete",
                    "Metrics have been calculated successfully. Configure OpenAI API key for automated insights.",
                    "medium", "operational", 1.0, "Add OPENAI_API_KEY to environment variables for AI-powered insights.")
FALLBACK_RECOMMENDATIONS = ["Configure OpenAI API key for automated insights",
                            "Upload larger dataset for more comprehensive analysis",
                            "Schedule regular data uploads for trend tracking"]
FALLBACK_NOTE = "Mock insights generated - configure AI for real analysis"
REPLY_FORMAT = """Please provide insights in the following JSON format:
{
"executive_summary": "Brief 2-3 sentence overview of business health",
"key_insights": [
{
"title": "Insight title",
"description": "Detailed explanation",
"impact": "high/medium/low",
"category": "revenue/customer/product/operational",
"confidence": 0.85,
"recommendation": "Actionable recommendation"
}
],
"growth_opportunities": [
{
"opportunity": "Description of opportunity",
"potential_impact": "Estimated impact",
"effort_required": "low/medium/high"
}
],
"risk_warnings": [
{
"risk": "Description of risk",
"severity": "high/medium/low",
"mitigation": "How to mitigate"
}
],
"top_recommendations": [
"Action 1",
"Action 2",
"Action 3"
]
}"""
FOCUS = """Focus on:
1. Revenue trends and growth opportunities
2. Customer behavior and retention
3. Product performance and optimization
4. Specific, actionable recommendations
5. Data-driven observations only

Be specific and avoid generic advice. Use the actual numbers provided."""
STATUS_HEALTHY, STATUS_STABLE, STATUS_ATTENTION = "healthy", "stable", "needs attention"
REC_REVENUE = "Implement upsell strategies and bundle products to increase average order value."
REC_CUSTOMER = "Develop a loyalty program and email re-engagement campaigns for one-time buyers."
REC_PRODUCT = "Analyze bottom 20% of products for potential discontinuation or bundling opportunities."
OPPORTUNITIES = [
    ("Convert one-time buyers to repeat customers", "15-25% revenue increase", "medium"),
    ("Expand average order value through product bundling", "10-15% revenue increase", "low"),
    ("Expand product catalog in high-performing categories", "20-30% revenue increase", "high"),
]
RISK_CHURN = ("High customer churn risk", "high", "Implement customer retention program immediately")
RISK_DECLINE = ("Significant revenue decline", "high", "Conduct urgent business review and cost optimization")
RISK_CONCENTRATION_MITIGATION = "Diversify product portfolio and reduce dependency"
TOP_RECOMMENDATIONS = [
    "Implement customer loyalty program to increase retention",
    "Optimize top-performing products with targeted marketing",
    "Analyze slow-moving inventory for clearance opportunities",
]
FALLBACK_SUMMARY = "Basic analysis completed. Unable to generate AI-powered insights at this time."


def _money(c: Column) -> Column:
    """``1,234.50`` (thousands separators, 2 digits)."""
    return F.format_number(dround(c, 2), 2)


def _fixed(c: Column, digits: int) -> Column:
    """``12.3`` (no separators, ``digits`` digits, rounded half up first)."""
    return F.format_string(f"%.{digits}f", dround(c, digits))


def _int(c: Column) -> Column:
    return F.format_number(c.cast("bigint"), 0)


def health_status(overall: Column) -> Column:
    """Overall >= 70 healthy, >= 40 stable, else needs attention."""
    return F.when(overall >= 70, STATUS_HEALTHY).when(overall >= 40, STATUS_STABLE).otherwise(STATUS_ATTENTION)


def insight_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics row + health scores + status, one row per business."""
    m = with_health(metrics_row(df, by))
    return m.withColumn("health_status", health_status(F.col("overall_health")))


def _rows(m: DataFrame, by: Sequence[str], items: list[tuple[Column, Column]]) -> DataFrame:
    """Emit ``struct`` rows whose condition holds, numbered by rule position."""
    arr = F.array(*[F.when(cond, s) for cond, s in items])
    return (m.select(*by, F.posexplode(arr).alias("position", "item")).where(F.col("item").isNotNull())
            .select(*by, (F.col("position") + 1).cast("bigint").alias("position"), "item.*"))


def key_insights(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue, customer, product and growth insights whose conditions hold."""
    return _rows(m, by, _key_insight_rules())


def _key_insight_rules() -> list[tuple[Column, Column]]:
    rev, tx = F.col("total_revenue"), F.col("total_transactions")
    avg, best = F.col("avg_transaction_value"), F.coalesce(F.col("best_day"), F.lit("N/A"))
    cust, one = F.col("customer_count"), F.col("one_time_customers")
    rate = one.cast("double") / F.greatest(cust, F.lit(1)) * 100
    tp, top_rev = F.col("product_rows"), F.coalesce(F.col("top_product_revenue"), F.lit(0.0))
    name = F.coalesce(F.col("top_product_name"), F.lit("No data"))
    mom = F.col("revenue_mom")

    def item(title, desc, impact, category, conf, rec):
        return F.struct(F.lit(title).alias("title"), desc.alias("description"), impact.alias("impact"),
                        F.lit(category).alias("category"), F.lit(conf).cast("double").alias("confidence"),
                        (rec if isinstance(rec, Column) else F.lit(rec)).alias("recommendation"))

    revenue = item("Revenue Performance",
                   F.concat(F.lit("Total revenue of $"), _money(rev), F.lit(" from "), _int(tx),
                            F.lit(" transactions. Average order value is $"), _fixed(avg, 2),
                            F.lit(". Best day: "), best, F.lit(".")),
                   F.when(rev > 10000, "high").otherwise("medium"), "revenue", 0.95, REC_REVENUE)
    customer = item("Customer Retention",
                    F.concat(_fixed(rate, 1), F.lit("% of customers are one-time buyers ("), one.cast("string"),
                             F.lit(" of "), cust.cast("string"), F.lit("). Average customer lifetime value is $"),
                             _fixed(F.col("avg_customer_value"), 2), F.lit(".")),
                    F.when(rate > 60, "high").otherwise("medium"), "customer", 0.9, REC_CUSTOMER)
    product = item("Product Portfolio",
                   F.concat(F.lit("Active product catalog of "), tp.cast("string"), F.lit(" items. Top product '"),
                            F.substring(name, 1, 30), F.lit("...' generates $"), _money(top_rev), F.lit(" in revenue.")),
                   F.lit("medium"), "product", 0.85, REC_PRODUCT)
    up = mom > 0
    growth = item("Growth Trajectory",
                  F.concat(F.lit("Month-over-month revenue growth is "), _fixed(mom, 1), F.lit("% ("),
                           F.when(up, "positive").otherwise("negative"), F.lit(" trend).")),
                  F.lit("high"), "revenue", 0.9,
                  F.concat(F.lit("Investigate drivers of "), F.when(up, "growth").otherwise("decline"),
                           F.lit(" and "), F.when(up, "scale").otherwise("address"), F.lit(" accordingly.")))
    return [(avg > 0, revenue), ((one > 0) & (cust > 0), customer), ((tp > 0) & (top_rev > 0), product), (mom.isNotNull(), growth)]


def growth_opportunities(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-time > 50 % of customers; always bundling; fewer than 50 products."""
    return _rows(m, by, _opportunity_rules())


def _opportunity_rules() -> list[tuple[Column, Column]]:
    def item(t):
        return F.struct(F.lit(t[0]).alias("opportunity"), F.lit(t[1]).alias("potential_impact"),
                        F.lit(t[2]).alias("effort_required"))
    cust, one = F.col("customer_count"), F.col("one_time_customers")
    return [(one > cust * 0.5, item(OPPORTUNITIES[0])), (F.lit(True), item(OPPORTUNITIES[1])),
            (F.col("product_rows") < 50, item(OPPORTUNITIES[2]))]


def risk_warnings(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """I4: churn (one-time > 70 %), decline (growth < -10 %), concentration (> 40 % in the
    top product)."""
    return _rows(m, by, _risk_rules())


def _risk_rules() -> list[tuple[Column, Column]]:
    def item(risk, sev, mit):
        return F.struct((risk if isinstance(risk, Column) else F.lit(risk)).alias("risk"),
                        F.lit(sev).alias("severity"), F.lit(mit).alias("mitigation"))
    cust, one = F.col("customer_count"), F.col("one_time_customers")
    rev, top_rev = F.col("total_revenue"), F.coalesce(F.col("top_product_revenue"), F.lit(0.0))
    conc = F.try_divide(top_rev, rev) * 100
    conc_text = F.concat(F.lit("High revenue concentration: Top product represents "), _fixed(conc, 1),
                         F.lit("% of revenue"))
    return [(one > cust * 0.7, item(*RISK_CHURN)),
            (F.coalesce(F.col("revenue_mom"), F.lit(0.0)) < -10, item(*RISK_DECLINE)),
            ((rev > 0) & (top_rev > 0) & (conc > 40), item(conc_text, "medium", RISK_CONCENTRATION_MITIGATION))]


def summary_text(m: DataFrame) -> Column:
    """The executive summary sentence (white space normalised to single blanks)."""
    mom = F.coalesce(F.col("revenue_mom"), F.lit(0.0))
    trend = F.coalesce(F.col("revenue_trend"), F.lit("stable"))
    trend = F.concat(F.upper(F.substring(trend, 1, 1)), F.lower(F.substring(trend, 2, 1 << 20)))
    return F.concat(
        F.lit("Business performance is "), F.col("health_status"), F.lit(" with $"), _money(F.col("total_revenue")),
        F.lit(" revenue from "), _int(F.col("total_transactions")), F.lit(" transactions. Customer base consists of "),
        _int(F.col("total_customers")), F.lit(" customers with average transaction value of $"),
        _fixed(F.col("avg_transaction_value"), 2), F.lit(". "), trend, F.lit(" revenue trend with "),
        _fixed(F.abs(mom), 1), F.lit("% "), F.when(mom > 0, "growth").otherwise("decline"),
        F.lit(" month-over-month. Best performing day is "), F.coalesce(F.col("best_day"), F.lit("N/A")), F.lit("."))


def recommendations(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The three fixed recommendations per business, with position."""
    arr = F.array(*[F.lit(t) for t in TOP_RECOMMENDATIONS])
    return m.select(*by, F.posexplode(arr).alias("position", "recommendation")) \
            .withColumn("position", (F.col("position") + 1).cast("bigint"))


def assemble(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per business: status, summary, counts of insights / opportunities / risks,
    enough-data flag (>= 10 invoices) and the rule engine used."""
    def count(items: list[tuple[Column, Column]]) -> Column:
        return F.size(F.filter(F.array(*[F.coalesce(cond, F.lit(False)) for cond, _ in items]), lambda holds: holds)).cast("bigint")

    return m.select(*by, "health_status", "overall_health", summary_text(m).alias("executive_summary"),
                    count(_key_insight_rules()).alias("insight_count"), count(_opportunity_rules()).alias("opportunity_count"),
                    count(_risk_rules()).alias("risk_count"),
                    (F.col("total_transactions") >= MIN_INVOICES_FOR_AI).alias("enough_data"), F.lit("rules").alias("engine"))


def prompt_metrics(df: DataFrame | Grains, by: Sequence[str] = ()) -> DataFrame:
    """The metrics row with what the analysis request shows besides: rows, the last three months, mean and median revenue,
    segments and RFM means. All from the stored aggregates of the rows."""
    by = list(by)
    g = df if isinstance(df, Grains) else Grains(df, by, with_values=True)
    months = K.monthly_revenue(g, by)
    last = Window.partitionBy(*by).orderBy(F.desc("period"))  # one row per month and business
    three = (months.withColumn("_k", F.row_number().over(last)).where("_k <= 3").groupBy(*by)
             .agg(F.array_sort(F.collect_list(F.struct("period", "revenue"))).alias("last_months")))
    spread = K.revenue_distribution(g, by).select(*by, dround("mean", 2).alias("mean_revenue"), dround("median", 2).alias("median_revenue"))
    place = F.array_position(F.array(*[F.lit(x) for x in SEGMENTS]), F.col("segment"))
    segments = (K.segment_distribution(g, by).groupBy(*by)
                .agg(F.array_sort(F.collect_list(F.struct((-F.col("customers")).alias("less"), place.alias("place"), "segment", "customers")))
                     .alias("segments")))
    out = insight_metrics(g, by)
    for part in (g.rows_per_group().select(*by, F.col("n").alias("total_rows")), three, spread, segments, K.rfm_summary(g, by)):
        out = join_one(out, part, by)
    return out


def prompt_text(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """I8: the analysis request text per business, from :func:`prompt_metrics` (data preparation for an offline batch of
    model calls; no call is made here). Lines have no indentation, and numbers in lists have two digits."""
    one_pct = dround(F.col("one_time_customers").cast("double") / F.greatest(F.col("customer_count"), F.lit(1)) * 100, 1)

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    def or_none(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))

    def line(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    months = F.array_join(F.transform("last_months", lambda x: line("('", x["period"], "', ", _fixed(x["revenue"], 2), ")")), ", ")
    segments = F.array_join(F.transform("segments", lambda x: line("'", x["segment"], "': ", x["customers"].cast("string"))), ", ")
    lines = [
        line("Analyze the following business metrics and generate actionable insights."), line(""),
        line("DATASET INFORMATION:"),
        line("- Time Period: ", or_none("date_start"), " to ", or_none("date_end")),
        line("- Total Rows: ", or_none("total_rows")),
        line("- Data Type: Retail transactions"), line(""),
        line("BUSINESS METRICS:"), line(""),
        line("SUMMARY METRICS:"),
        line("- Total Revenue: $", _money(F.col("total_revenue"))),
        line("- Total Transactions: ", _int(F.col("total_transactions"))),
        line("- Total Customers: ", _int(F.col("total_customers"))),
        line("- Average Transaction Value: $", _fixed(F.col("avg_transaction_value"), 2)),
        line("- Total Products: ", _int(F.col("total_products"))), line(""),
        line("REVENUE ANALYSIS:"),
        line("- Monthly Revenue Trend: ", F.coalesce(line("[", months, "]"), F.lit("N/A"))),
        line("- Best Performing Day: ", or_none("best_day")),
        line("- Revenue Distribution - Mean: $", _fixed(zero("mean_revenue"), 2), ", Median: $", _fixed(zero("median_revenue"), 2)), line(""),
        line("CUSTOMER ANALYSIS:"),
        line("- Total Customers: ", _int(F.col("customer_count"))),
        line("- One-time Customers: ", _int(F.col("one_time_customers")), " (", _fixed(one_pct, 1), "%)"),
        line("- Average Customer Value: $", _fixed(F.col("avg_customer_value"), 2)),
        line("- Segment Distribution: {", F.coalesce(segments, F.lit("")), "}"),
        line("- RFM Scores - Recency: ", _fixed(zero("avg_recency"), 1), " days, Frequency: ", _fixed(zero("avg_frequency"), 1),
             ", Monetary: $", _fixed(zero("avg_monetary"), 2)), line(""),
        line("PRODUCT ANALYSIS:"),
        line("- Total Products: ", _int(F.col("product_rows"))),
        line("- Top Product: ", F.coalesce(F.col("top_product_name"), F.lit("No data")), " ($", _money(zero("top_product_revenue")), ")"),
        line("- Average Product Price: $", _fixed(zero("avg_product_price"), 2)), line(""),
        line("GROWTH METRICS:"),
        line("- Month-over-Month Growth: ", F.coalesce(_fixed(F.col("revenue_mom"), 2), F.lit("N/A")), "%"),
        line("- Overall Trend: ", F.coalesce(F.col("revenue_trend"), F.lit("stable"))), line(""),
        line(REPLY_FORMAT), line(""), line(FOCUS),
    ]
    return m.select(*by, F.concat_ws("\n", *lines).alias("prompt"))


def documents(m: DataFrame, by: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
    """I7 in full: one row per business with its summary, insights, opportunities, risks, recommendations and a note. A
    business of ``keys`` without metrics gets the fallback document. The arrays hold at most as many items as there are
    rules."""
    by = list(by)

    def rows(rules: list[tuple[Column, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), item) for cond, item in rules]))

    fixed = F.array(*[F.lit(t) for t in TOP_RECOMMENDATIONS])
    out = m.select(*by, summary_text(m).alias("executive_summary"), rows(_key_insight_rules()).alias("key_insights"),
                   rows(_opportunity_rules()).alias("growth_opportunities"), rows(_risk_rules()).alias("risk_warnings"),
                   fixed.alias("top_recommendations"), F.lit(None).cast("string").alias("note"))
    if keys is None or not by:
        return out
    missing = keys.select(*by).distinct().join(m.select(*by), on=by, how="left_anti")
    title, text, impact, category, confidence, advice = FALLBACK_INSIGHT
    insight = F.struct(F.lit(title).alias("title"), F.lit(text).alias("description"), F.lit(impact).alias("impact"), F.lit(category).alias("category"),
                       F.lit(confidence).cast("double").alias("confidence"), F.lit(advice).alias("recommendation"))
    types = {f.name: f.dataType for f in out.schema.fields}
    return out.unionByName(missing.select(
        *by, F.lit(FALLBACK_SUMMARY).alias("executive_summary"), F.array(insight).cast(types["key_insights"]).alias("key_insights"),
        F.array().cast(types["growth_opportunities"]).alias("growth_opportunities"), F.array().cast(types["risk_warnings"]).alias("risk_warnings"),
        F.array(*[F.lit(t) for t in FALLBACK_RECOMMENDATIONS]).alias("top_recommendations"), F.lit(FALLBACK_NOTE).alias("note")))


def validate_replies(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """JSON replies checked for the three required fields, two of them lists."""
    v = F.col(col)
    keys = F.json_object_keys(v)
    parsed = keys.isNotNull()
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    is_list = lambda k: F.coalesce(F.substring(F.ltrim(F.get_json_object(v, f"$.{k}")), 1, 1) == "[", F.lit(False))
    valid = parsed & has("executive_summary") & has("key_insights") & has("top_recommendations") \
        & is_list("key_insights") & is_list("top_recommendations")
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("replies"),
                               F.count_if(parsed).cast("bigint").alias("parsed_objects"),
                               F.count_if(~parsed | v.isNull()).cast("bigint").alias("malformed"),
                               F.count_if(valid).cast("bigint").alias("valid"),
                               F.count_if(parsed & ~valid).cast("bigint").alias("invalid_structure"))


__all__ = ["assemble", "fmt_label", "growth_opportunities", "health_status", "insight_metrics",
           "key_insights", "prompt_text", "recommendations", "risk_warnings", "summary_text",
           "validate_replies"]
