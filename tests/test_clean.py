from decimal import Decimal

from pyspark.sql import functions as F

from tests.conftest import rows, ts
from tillroll.operators import clean as C
from tillroll.schema import RAW_TEXT_SCHEMA


def D(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


def test_returns_arithmetic(spark):
    # Quantity [5, -2, 10], UnitPrice [10, 10, 20]: sales 250, returns 20, net 230, rate 8 %.
    df = rows(spark, [("I1", "S1", "A", 5.0, ts("2023-01-01"), D(10), "C1", "UK"),
                      ("I2", "S1", "A", -2.0, ts("2023-01-02"), D(10), "C1", "UK"),
                      ("I3", "S2", "B", 10.0, ts("2023-01-03"), D(20), "C2", "UK")])
    cl = C.clean(df)
    s = cl.agg(F.sum("SalesRevenue"), F.sum("ReturnsValue"), F.sum("NetRevenue")).first()
    assert float(s[0]) == 250 and float(s[1]) == 20 and float(s[2]) == 230
    rr = C.return_rate(cl).first()
    assert rr.return_rate == 8.0 and rr.gross_sales == 250.0 and rr.net_revenue == 230.0


def test_basic_dirty_rows_removed(spark):
    raw = spark.createDataFrame([
        (None, "S1", None, "-2", "invalid", "-5", None, None),
        ("I2", "S2", "x", "3", "01/02/2023 10:00", "2.50", "C9", " united kingdom "),
        ("I3", "S3", "y", "0", "01/02/2023 10:00", "2.50", "C9", "france"),
    ], RAW_TEXT_SCHEMA)
    cl = C.clean(raw)
    assert {"TransactionValue", "IsReturn", "Revenue", "Weekday", "DataQualityScore", "QualityFlag",
            "NeedsReview"} <= set(cl.columns)
    got = cl.collect()
    assert len(got) == 1
    r = got[0]
    assert r.Country == "United Kingdom" and r.Description == "x" and r.Quantity == 3.0
    assert r.InvoiceDate == ts("2023-02-01 10:00:00")
    rep = {x.reason: x.removed for x in C.removal_report(C.prepare(raw)).collect()}
    assert rep == {"invalid_dates": 1, "zero_quantity": 1, "total_removed": 2}


def test_extremes_not_flagged_below_three_times_q99(spark):
    # 3 x q99 of {5, 1000, 1} is about 2940: nothing exceeds it.
    df = rows(spark, [("I1", "S1", "A", 5.0, ts("2023-01-01"), D(10), "C1", "UK"),
                      ("I2", "S1", "A", 1000.0, ts("2023-01-02"), D(20), "C1", "UK"),
                      ("I3", "S1", "A", 1.0, ts("2023-01-03"), D(1000), "C1", "UK")])
    cl = C.clean(df)
    assert cl.where(F.col("QualityFlag").isNotNull()).count() == 0
    assert {r.DataQualityScore for r in cl.collect()} == {1.0}


def test_quality_flags_and_score(spark):
    data = [(f"I{i}", "S1", "A", 1.0, ts("2023-01-01"), D(1), "C1", "UK") for i in range(200)]
    data.append(("X", "S1", "A", 500.0, ts("2023-01-01"), D(900), "C1", "UK"))
    cl = C.clean(rows(spark, data))
    x = cl.where("InvoiceNo = 'X'").first()
    assert x.QualityFlag == "Extreme price"          # price flag overrides quantity flag
    assert abs(x.DataQualityScore - 0.7 * 0.7) < 1e-12


def test_exact_duplicates_only(spark):
    # Two repeated invoice-product pairs, but every row differs in date: no exact duplicate.
    base = [("I1", "S1", "A", 1.0, ts("2023-01-01"), D(1), "C1", "UK"),
            ("I1", "S1", "A", 1.0, ts("2023-01-02"), D(1), "C1", "UK"),
            ("I2", "S2", "A", 1.0, ts("2023-01-03"), D(1), "C1", "UK"),
            ("I2", "S2", "A", 1.0, ts("2023-01-04"), D(1), "C1", "UK"),
            ("I3", "S3", "A", 1.0, ts("2023-01-05"), D(1), "C1", "UK")]
    cl = C.clean(rows(spark, base))
    assert cl.count() == 5
    m = C.multi_entries(cl).first()
    assert m.legitimate_multiple_entries == 2 and m.total_multiple_entry_rows == 4
    # an exact copy is removed
    assert C.clean(rows(spark, base + [base[0]])).count() == 5


def test_suspicious_cluster(spark):
    data = [("I1", f"S{i}", "A", 1.0, ts("2023-01-01 10:00:05"), D(1), "C1", "UK") for i in range(4)]
    data += [("I2", f"S{i}", "A", 1.0, ts("2023-01-01 10:00:05"), D(1), "C1", "UK") for i in range(3)]
    cl = C.clean(rows(spark, data))
    flags = {(r.InvoiceNo, r.NeedsReview) for r in cl.collect()}
    assert flags == {("I1", True), ("I2", None)}


def test_mode_fill_ties_smallest(spark):
    raw = spark.createDataFrame([("I1", "S", "d", "1", "01/01/2023 00:00", "1.00", "C", c)
                                 for c in ["b", "a", "b", "a", None]], RAW_TEXT_SCHEMA)
    got = [r.Country for r in C.fill_mode(raw).collect()]
    assert got.count("a") == 3


def test_mode_fill_all_null_unknown(spark):
    raw = spark.createDataFrame([("I1", "S", "d", "1", "01/01/2023 00:00", "1.00", "C", None)], RAW_TEXT_SCHEMA)
    assert C.fill_mode(raw).first().Country == "Unknown"


def test_title_case_restarts_after_non_letters(spark):
    df = spark.createDataFrame([("u.s.a",), ("o'brien",), ("NATION_7",), ("  élan vital ",)], "c string")
    from tillroll.functions.columns import strip_ws, title_case
    got = [r[0] for r in df.select(title_case(strip_ws(F.col("c")))).collect()]
    assert got == ["U.S.A", "O'Brien", "Nation_7", "Élan Vital"]


def test_sanitize_text(spark):
    df = spark.createDataFrame([("  a\tb\n  c  ",), (None,)], "t string")
    got = [r.t for r in C.sanitize(df, ["t"]).collect()]
    assert got == ["ab c", ""]


def test_fill_report_counts(spark):
    raw = spark.createDataFrame([("I1", "S", None, None, "01/01/2023 00:00", "1.00", None, "UK"),
                                 ("I2", "S", "d", "1", "01/01/2023 00:00", None, "C", None)], RAW_TEXT_SCHEMA)
    rep = {r.column: r.filled for r in C.fill_report(raw).collect()}
    assert rep == {"CustomerID": 1, "Description": 1, "Country": 1, "Quantity": 1, "UnitPrice": 1}


def test_suspicious_stays_inside_a_group(spark):
    rows_ = [(g, "i1", ts("2011-01-01 10:00:00")) for g in ("a", "b") for _ in range(2)]
    df = spark.createDataFrame(rows_, "g string, InvoiceNo string, InvoiceDate timestamp_ntz")
    assert C.suspicious(df).where("NeedsReview").count() == 4
    assert C.suspicious(df, ["g"]).where("NeedsReview").count() == 0


def test_bad_numbers_end_no_job(spark):
    df = spark.createDataFrame([(q, "2") for q in ("1e16", "NaN", "-Infinity", "x", None, "3")], "Quantity string, UnitPrice string")
    got = C.revenue_columns(C.cast_types(df)).collect()
    assert sorted(float(r.Revenue) for r in got) == [0.0] * 5 + [6.0]


def test_single_digit_and_iso_dates(spark):
    texts = ["1/12/2010 8:26", "2010-12-01T08:26:00", "2010-12-01 08:26:00.5", "01/12/2010 08:26", "invalid"]
    got = C.cast_types(spark.createDataFrame([(t,) for t in texts], "InvoiceDate string")).collect()
    assert [r.InvoiceDate and r.InvoiceDate.replace(microsecond=0) for r in got] == [ts("2010-12-01 08:26:00")] * 4 + [None]


def test_prices_below_a_cent_stay(spark):
    # Expected values are those of floats, as in the reference.
    texts = ["0.004", "1.005", "0.000001", "0.0049", "2.5", "9999999999999999.99", "-0.004", "0", "x", None]
    raw = spark.createDataFrame([(f"I{i}", "S", "d", "1000", "01/02/2023 10:00", t, "C", "UK") for i, t in enumerate(texts)], RAW_TEXT_SCHEMA)
    want = {f"I{i}": float(t) for i, t in enumerate(texts[:6])}
    got = C.clean(raw).collect()
    assert {r.InvoiceNo: float(r.UnitPrice) for r in got} == want
    assert {r.InvoiceNo: float(r.Revenue) for r in got} == {k: round(1000 * v, 6) for k, v in want.items()}
    report = {r.reason: r.removed for r in C.removal_report(C.prepare(raw)).collect()}
    assert report == {"invalid_prices": 4, "total_removed": 4}
    three = C.return_rate(C.clean(raw.where("InvoiceNo in ('I0', 'I1', 'I3')"))).first()
    assert three.gross_sales == 1013.9


def test_dates_by_shape(spark):
    texts = {"2010/12/1 8:26": "2010-12-01 08:26:00", "20101201": "2010-12-01 00:00:00", "1/12/10 8:26": "2010-12-01 08:26:00",
             "12/25/2010": "2010-12-25 00:00:00", "25.12.2010 8:26 pm": "2010-12-25 20:26:00", "1 Dec 2010 08:26": "2010-12-01 08:26:00",
             "1-December-69": "1969-12-01 00:00:00", "Dec 1, 2010 8:26": "2010-12-01 08:26:00", "2010-12-01T08:26:00Z": "2010-12-01 08:26:00",
             "2010-12-01 08:26:00 -0530": "2010-12-01 13:56:00", "13.13.2010": None, "30/02/2010": None, "2010-12": None, "": None,
             "1 Foo 2010": None, "01/02/2010 25:00": None}
    got = C.cast_types(spark.createDataFrame([(t, t) for t in texts], "InvoiceDate string, t string")).collect()
    assert {r.t: r.InvoiceDate and str(r.InvoiceDate) for r in got} == texts


def test_out_of_range_has_its_own_reason(spark):
    raw = spark.createDataFrame([("I1", "S", "d", "1e15", "01/02/2023", "1.5", "C", "UK"), ("I2", "S", "d", "0.0004", "01/02/2023", "1000", "C", "UK"),
                                 ("I3", "S", "d", "9e11", "01/02/2023", "9e14", "C", "UK")], RAW_TEXT_SCHEMA)
    assert {r.reason: r.removed for r in C.removal_report(C.prepare(raw)).collect()} == {"out_of_range": 2, "total_removed": 2}
    assert [(r.InvoiceNo, float(r.Revenue)) for r in C.clean(raw).collect()] == [("I2", 0.4)]


def test_hot_invoice_minute(spark):
    """A third of all rows in one (invoice, minute): flags as by a window, and the rows of the pair are spread in the join."""
    data = [("hot", f"S{i}", "2023-01-01 10:00") for i in range(2000)]
    data += [(f"I{i % 900}", f"S{i}", f"2023-01-01 10:{i % 4:02d}") for i in range(4000)] + [(None, "S", "2023-01-01 10:00")] * 9
    df = spark.createDataFrame(data, "InvoiceNo string, StockCode string, t string").withColumn(
        "InvoiceDate", F.to_timestamp("t").cast("timestamp_ntz"))
    got = C.suspicious(df)
    want = {}
    for i, _, t in data:
        want[i, t] = want.get((i, t), 0) + 1
    flagged = sorted((i, t) for (i, t), n in want.items() if i and n > 3)
    assert sorted((r.InvoiceNo, r.t) for r in got.where("NeedsReview").select("InvoiceNo", "t").distinct().collect()) == flagged
    assert got.count() == len(data) and got.where("NeedsReview").count() == sum(want[k] for k in flagged)


def test_clean_reads_its_profile_per_group(spark):
    raw = spark.createDataFrame([(g, f"I{i}", "S", "d", "1", "01/01/2023", "1", "C", c) for g, cs in
                                 {"a": ["x", "x", None], "b": ["y", "y", "z", None], None: [None]}.items() for i, c in enumerate(cs)],
                                "g string, " + ", ".join(f"{c} string" for c in RAW_TEXT_SCHEMA.names))
    got = {(r.g, r.InvoiceNo): r.Country for r in C.clean(raw, ["g"]).collect()}
    assert got["a", "I2"] == "X" and got["b", "I3"] == "Y" and got[None, "I0"] == "Unknown"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dates_are_not_parsed_again_by_the_filter(spark):
    raw = spark.createDataFrame([("I1", "S1", "x", "1", "01/02/2023 10:00", "2.50", "C", "uk")], RAW_TEXT_SCHEMA)
    filters = [line for line in _plan(C.valid_rows(raw)).splitlines() if "Filter" in line]
    assert filters and not any("RLIKE" in f or "regexp_replace" in f for f in filters)


def test_flags_and_clusters_do_not_make_their_input_again(spark):
    df = rows(spark, [("I1", "S1", "A", float(i), ts("2023-01-01"), D(10), "C1", "UK") for i in range(1, 6)])
    for marked in (C.suspicious(df), C.quality_flags(df)):
        assert "LogicalRDD" not in _plan(marked)
        assert marked.count() == 5
    assert C.suspicious(df).where("NeedsReview").count() == 5


def test_plain_trim_and_initcap_equal_the_patterns(spark):
    from tillroll.functions.columns import strip_ws, title_case
    texts = ["", " ", "\t\n a b \x0b\r", "a \u0085", "a  ", " a  ", "a ", "\x1c a", "unITED  kingdom", "u.s.a", "a\tb", "a\n", "ǆx", "o'neil"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "c string")
    runs = "array_join(transform(regexp_extract_all(c, '(\\\\p{L}+|[^\\\\p{L}]+)', 1), r -> concat(upper(substring(r, 1, 1)), lower(substring(r, 2)))), '')"
    for r in df.select(strip_ws("c").alias("a"), F.regexp_replace("c", r"^\s+|\s+$", "").alias("b"),
                       title_case("c").alias("x"), F.expr(runs).alias("y")).collect():
        assert r.a == r.b and r.x == r.y


def test_dates_of_fixed_width(spark):
    from tillroll.functions.dates import parse_dates
    # The same date with seconds takes the general way.
    texts = ["01/02/2023 10:05", "31/12/2023 23:59", "12/31/2023 00:00", "13/13/2023 10:00", "29.02.2023 10:00", "29-02-2024 24:00",
             "2023-12-31 08:30", "2023/31/12 08:30", "0000/01/01 08:60", "00-00-2023 10:00", "01/02-2023 10:05", " 01/02/2023 10:05 "]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = df.select("c", parse_dates(F.col("c")).alias("a"), parse_dates(F.concat(F.trim("c"), F.lit(":00"))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(r.a is not None for r in got) == 6, got
