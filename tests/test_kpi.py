from decimal import Decimal

from pyspark.sql import functions as F

from tests.conftest import rows, ts
from tillroll.operators import clean as C
from tillroll.operators import kpi as K
from tillroll.operators import topk as T
from tillroll.operators import windows as W
from tillroll.operators.health import health_scores
from tillroll.plans.metrics import long_metrics, metric_count


def D(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


def enrich(df):
    return C.date_parts(C.revenue_columns(df))


def base(spark):
    # Revenue 50, 60, 100, 100, 20 (the studied application's KPI fixture).
    data = [("INV001", "SKU001", "Product A", 5.0, "2023-01-01", 10.0, "C001", "UK"),
            ("INV001", "SKU002", "Product B", 3.0, "2023-01-02", 20.0, "C001", "UK"),
            ("INV002", "SKU001", "Product A", 10.0, "2023-01-03", 10.0, "C002", "USA"),
            ("INV003", "SKU003", "Product C", 1.0, "2023-01-04", 100.0, "C003", "Germany"),
            ("INV004", "SKU001", "Product A", 2.0, "2023-01-05", 10.0, "C004", "France")]
    return enrich(rows(spark, [(a, b, c, q, ts(d), D(p), cu, co) for a, b, c, q, d, p, cu, co in data]))


def test_summary_basic(spark):
    s = K.summary(base(spark)).first()
    assert s.total_revenue == 330 and s.total_transactions == 4 and s.total_customers == 4
    assert s.total_products == 3 and s.avg_transaction_value == 82.5
    d = K.revenue_distribution(base(spark)).first()
    assert d.mean == 66.0 and d.min == 20 and d.max == 100 and d.median == 60.0
    assert K.customer_overview(base(spark)).first().customer_count == 4
    assert K.product_overview(base(spark)).first().total_products == 3


def test_returns_and_nulls(spark):
    df = enrich(rows(spark, [("INV001", "SKU001", "A", 5.0, ts("2023-01-01"), D(10), "C001", "UK"),
                             ("INV001", "SKU001", "A", -2.0, ts("2023-01-02"), D(10), "C001", "UK"),
                             ("INV002", "SKU002", "B", 10.0, ts("2023-01-03"), D(20), "C002", "USA")]))
    s = K.summary(df).first()
    assert s.total_revenue == 230 and s.total_transactions == 2
    nulls = enrich(rows(spark, [("INV001", "SKU001", "A", 5.0, ts("2023-01-01"), D(10), "C001", "UK"),
                                ("INV002", "SKU002", "B", 10.0, ts("2023-01-02"), D(20), None, None),
                                ("INV003", "SKU001", "A", 3.0, ts("2023-01-03"), D(10), None, "USA")]))
    assert K.summary(nulls).first().total_revenue == 280
    assert K.customer_overview(nulls).first().customer_count >= 1


def test_edges(spark):
    zero = enrich(rows(spark, [("INV001", "SKU001", "A", 5.0, ts("2023-01-01"), D(0), "C001", "UK")]))
    assert K.summary(zero).first().total_revenue == 0
    single = enrich(rows(spark, [("INV001", "SKU001", "A", 5.0, ts("2023-01-01"), D(10), "C001", "UK")]))
    s = K.summary(single).first()
    assert s.total_transactions == 1 and s.avg_transaction_value == 50.0
    unknown = enrich(rows(spark, [("INV001", "SKU001", "A", 5.0, ts("2023-01-01"), D(10), None, "UK"),
                                  ("INV002", "SKU002", "B", 10.0, ts("2023-01-02"), D(20), None, "USA")]))
    co = K.customer_overview(unknown).first()
    assert co.customer_count == 0
    # a single month: no growth, health unchanged by it, no crash
    h = health_scores(single).first()
    assert h.revenue_health == 50.0 and h.product_health == 50.0


def test_months_and_seasonality(spark):
    df = enrich(rows(spark, [("INV001", "SKU001", "A", 5.0, ts("2023-01-15"), D(10), "C001", "UK"),
                             ("INV002", "SKU002", "B", 10.0, ts("2023-02-20"), D(20), "C002", "USA"),
                             ("INV003", "SKU003", "C", 3.0, ts("2023-03-10"), D(15), "C003", "Germany")]))
    m = {r.period: r.revenue for r in K.monthly_revenue(df).collect()}
    assert m == {"2023-01": 50.0, "2023-02": 200.0, "2023-03": 45.0}
    best = K.seasonality(df).first().best_day
    assert best == "Monday"  # 2023-02-20 is a Monday, with the highest mean
    g = {r.period: (r.revenue_mom, r.revenue_trend, r.is_latest) for r in W.monthly_growth(df).collect()}
    assert g["2023-01"] == (None, None, False)
    assert g["2023-02"] == (300.0, "increasing", False)
    assert g["2023-03"] == (-77.5, "decreasing", True)


def test_invariants_on_tables(spark):
    from tillroll.catalog.bases import tx
    df = tx(spark, "/root/testdata/sf0.001")
    total = K.summary(df).first().total_revenue
    for part in (K.monthly_revenue(df), K.quarterly_revenue(df), K.weekday_revenue(df)):
        assert abs(sum(r.revenue for r in part.collect()) - total) < 0.05
    seg = sum(r.customers for r in K.segment_distribution(df).collect())
    assert seg == K.customer_overview(df).first().customer_count
    par = W.pareto(df).orderBy("rank").collect()
    assert [r.rank for r in par] == list(range(1, len(par) + 1))
    assert par[-1].cumulative_pct == 100.0
    assert T.top_customers(df).count() == 10


def test_empty_input_status_row(spark):
    empty = enrich(rows(spark, []))
    m = long_metrics(empty).where("section = '_metadata'").collect()
    assert len(m) == 1 and m[0].text == "No data available"
    assert metric_count(long_metrics(empty)).first() is None or \
        metric_count(long_metrics(empty)).first().metric_count >= 0


def test_segments_edges_collapse_to_medium(spark):
    same = enrich(rows(spark, [(f"I{i}", "S", "A", 1.0, ts("2023-01-01"), D(10), f"C{i}", "UK") for i in range(6)]))
    assert {r.segment for r in K.customer_segments(same).collect()} == {"Medium"}
    spread = enrich(rows(spark, [(f"I{i}", "S", "A", 1.0, ts("2023-01-01"), D(10 * (i + 1)), f"C{i}", "UK")
                                 for i in range(8)]))
    seg = {r.CustomerID: r.segment for r in K.customer_segments(spread).collect()}
    assert [seg[f"C{i}"] for i in range(8)] == ["Low", "Low", "Medium", "Medium", "High", "High", "VIP", "VIP"]


def test_by_keys_match_single_runs(spark):
    from tillroll.catalog.bases import keyed
    df = keyed(spark, "/root/testdata/sf0.001")
    by = {r.Region: r for r in K.summary(df, ["Region"]).collect()}
    for region, row in by.items():
        one = K.summary(df.where(F.col("Region") == region)).first()
        assert one.total_revenue == row.total_revenue and one.total_customers == row.total_customers
