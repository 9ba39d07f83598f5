from pyspark.sql import functions as F

from tillroll.operators import insights as I
from tillroll.operators.health import health_from_metrics

M = dict(total_revenue=20000.0, total_transactions=150, total_customers=60, total_products=30, date_start="2023-01-01",
         date_end="2023-03-31", avg_transaction_value=133.33, customer_count=60, one_time_customers=45,
         avg_customer_value=333.33, product_rows=30, avg_product_price=12.5, revenue_mom=-12.0,
         revenue_trend="decreasing", top_product_name="A VERY LONG PRODUCT NAME THAT GOES ON", top_product_revenue=9000.0,
         best_day="Friday")


SCHEMA = ("total_revenue double, total_transactions long, total_customers long, total_products long, "
          "date_start string, date_end string, avg_transaction_value double, customer_count long, "
          "one_time_customers long, avg_customer_value double, product_rows long, avg_product_price double, "
          "revenue_mom double, revenue_trend string, top_product_name string, top_product_revenue double, "
          "best_day string")


def metrics(spark, **kw):
    d = dict(M)
    d.update(kw)
    return spark.createDataFrame([tuple(d[k] for k in M)], SCHEMA)


def test_health_rules(spark):
    h = health_from_metrics(metrics(spark)).first()
    # revenue: 50 + 10 + 10 - 10 = 60; customer: 50 + 20 (+0, 45 one-time not < 30) = 70; product 50 + 20
    assert (h.revenue_health, h.customer_health, h.product_health) == (60.0, 70.0, 70.0)
    assert h.overall_health == 65.0
    h2 = health_from_metrics(metrics(spark, revenue_mom=35.0, one_time_customers=10)).first()
    assert h2.revenue_health == 90.0 and h2.customer_health == 80.0
    h3 = health_from_metrics(metrics(spark, revenue_mom=None)).first()
    assert h3.revenue_health == 70.0


def test_insight_rules(spark):
    m = metrics(spark).withColumn("health_status", I.health_status(F.lit(65.0)))
    k = {r.title: r for r in I.key_insights(m).collect()}
    assert set(k) == {"Revenue Performance", "Customer Retention", "Product Portfolio", "Growth Trajectory"}
    assert k["Revenue Performance"].description == (
        "Total revenue of $20,000.00 from 150 transactions. Average order value is $133.33. Best day: Friday.")
    assert k["Customer Retention"].impact == "high"   # 75 % one-time
    assert k["Product Portfolio"].description.startswith("Active product catalog of 30 items. Top product 'A VERY LONG PRODUCT NAME THAT ...'")
    assert k["Growth Trajectory"].description == "Month-over-month revenue growth is -12.0% (negative trend)."
    risks = [r.risk for r in I.risk_warnings(m).orderBy("position").collect()]
    assert risks[0] == "High customer churn risk" and risks[1] == "Significant revenue decline"
    assert risks[2] == "High revenue concentration: Top product represents 45.0% of revenue"
    ops = [r.opportunity for r in I.growth_opportunities(m).collect()]
    assert len(ops) == 3
    text = m.select(I.summary_text(m)).first()[0]
    assert text.startswith("Business performance is stable with $20,000.00 revenue from 150 transactions.")
    assert "Decreasing revenue trend with 12.0% decline month-over-month. Best performing day is Friday." in text


def test_no_growth_means_no_growth_insight(spark):
    m = metrics(spark, revenue_mom=None, revenue_trend=None)
    assert "Growth Trajectory" not in {r.title for r in I.key_insights(m).collect()}


def test_validate_replies(spark):
    df = spark.createDataFrame([('{"executive_summary": "x", "key_insights": [], "top_recommendations": ["a"]}',),
                                ('{"executive_summary": "x", "key_insights": {}, "top_recommendations": []}',),
                                ('not json',), (None,)], "reply string")
    r = I.validate_replies(df, "reply").first()
    assert (r.replies, r.valid, r.invalid_structure, r.malformed) == (4, 1, 1, 2)
