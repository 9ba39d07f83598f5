import random

import numpy as np
from pyspark.sql import functions as F

from tillroll.plans.prefix import running_total
from tillroll.plans.quantiles import percentiles, percentiles_of


def test_running_total_matches_brute_force_with_hot_key(spark):
    random.seed(7)
    # one key holds a third of all rows
    data = [("hot" if i % 3 == 0 else f"k{i % 11}", i, random.randint(-5, 20)) for i in range(3000)]
    df = spark.createDataFrame(data, "key string, id long, v long")
    r = running_total(df, [F.col("v").desc(), F.col("id").asc()], "v", ["key"], num_partitions=7).collect()
    by_key = {}
    for k, i, v in data:
        by_key.setdefault(k, []).append((i, v))
    expect = {}
    for k, items in by_key.items():
        items.sort(key=lambda t: (-t[1], t[0]))
        run = 0
        for n, (i, v) in enumerate(items, 1):
            run += v
            expect[(k, i)] = (n, run, len(items))
    got = {(x.key, x.id): (x._rank, x._running, x._group_rows) for x in r}
    assert got == expect


def test_percentiles_equal_numpy_bit_for_bit(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 100, 4000).round(2), np.full(3000, 7.5)])  # a hot value
    grp = np.where(np.arange(len(vals)) % 4 == 0, "a", "b")
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(grp, vals)] + [("a", None)], "g string, v double")
    probs = [0.0, 1.0, *np.linspace(0.003, 0.997, 60).tolist()]
    names = [f"q{i}" for i in range(len(probs))]
    for by in ([], ["g"]):
        for slices in (1, 2, 37):
            rows = percentiles(df, "v", probs, by, names, slices=slices).collect()
            assert len(rows) == (2 if by else 1)
            for r in rows:
                sel = vals if not by else vals[grp == r[0]]
                assert list(r[len(by):]) == np.quantile(sel, probs).tolist()


def test_percentiles_of_many_distinct_values_and_a_hot_group(spark):
    n = 2_400_000
    df = spark.range(n).select((F.col("id") % 3 == 0).alias("hot"), F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("g"),
                               (F.xxhash64("id") / 1000.0).alias("v"))
    pdf = df.toPandas()
    probs = [0.25, 0.5, 0.99]
    got = {r[0]: list(r[1:]) for r in percentiles(df, "v", probs, ["g"]).collect()}
    assert len(got) == 8  # the null key, with a third of the rows, is a group too
    for key, values in got.items():
        sel = pdf.v[pdf.g.isna() if key is None else pdf.g == key].to_numpy()
        assert values == np.quantile(sel, probs).tolist()


def test_percentiles_of_several_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, None), ("a", 4.0, 9), ("b", None, 3), ("c", None, None)],
                               "g string, v double, w int")
    wanted = {"v": {"v50": 0.5}, "w": {"w0": 0.0, "w50": 0.5}}
    got = {r.g: (r.v50, r.w0, r.w50) for r in percentiles_of(df, wanted, ["g"]).collect()}
    assert got == {"a": (2.0, 5.0, 7.0), "b": (None, 3.0, 3.0)}
    assert [tuple(r) for r in percentiles_of(df.limit(0), wanted).collect()] == [(None, None, None)]


def test_percentiles_empty_input(spark):
    df = spark.createDataFrame([], "v double")
    r = percentiles(df, "v", [0.5]).collect()
    assert len(r) == 1 and r[0][0] is None


def test_running_total_of_decimals_without_keys(spark):
    from decimal import Decimal
    data = [(i, Decimal(i % 37).scaleb(-3) + Decimal(10) ** 20) for i in range(500)]
    df = spark.createDataFrame(data, "id long, v decimal(30,6)")
    got = running_total(df, [F.col("id").desc()], "v", num_partitions=9).orderBy("_rank").collect()
    total = Decimal(0)
    for n, (r, (i, v)) in enumerate(zip(got, reversed(data)), 1):
        total += v
        assert (r.id, r._rank, r._running, r._group_rows) == (i, n, total, 500)
    assert got[-1]._group_total == total and running_total(df.limit(0), [F.col("id").asc()], "v").count() == 0


def test_ranks_take_one_shuffle_of_the_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    r = running_total(df, [F.col("id").asc()], None, ["k"], totals=False)
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "RepartitionByExpression" not in plan
    assert sorted((x.k, x._rank) for x in r.collect()) == sorted((k, i) for k in range(3) for i in range(1, 334 + (k == 0)))


def test_pages(spark):
    from tillroll.plans.prefix import PageIndex
    data = [(i // 3, f"n{i:04d}") for i in range(1000)]
    index = PageIndex(spark.createDataFrame(data, "d int, n string").repartition(5), {"d": True, "n": False}, num_partitions=8)
    want = sorted(data, key=lambda r: (-r[0], r[1]))
    for skip, limit in ((0, 10), (495, 300), (990, 50), (1000, 5)):
        got = sorted(index.page(skip, limit).collect(), key=lambda r: r.position)
        assert [(r.d, r.n) for r in got] == want[skip:skip + limit] and [r.position for r in got] == list(range(skip + 1, min(skip + limit, 1000) + 1))
        if 0 < skip < 1000:
            assert [tuple(r) for r in index.after(want[skip - 1], limit).collect()] == want[skip:skip + limit]
    assert index.total() == 1000 and index.after(want[-1], 5).count() == 0
    page = index.page(990, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_slice" in page or "_slice" in page


def test_percentiles_make_their_frequencies_once(spark):
    df = spark.createDataFrame([(float(i % 50),) for i in range(500)], "v double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = percentiles(df, "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Scan ExistingRDD") == 1, plan


def test_grains_of_invoices_in_several_groups(spark, monkeypatch):
    from datetime import datetime
    from decimal import Decimal

    from tillroll.plans import grains
    from tillroll.plans.grains import GRAINS, Grains

    random.seed(11)
    pick = lambda xs: random.choice([*xs, None])
    data = [(pick(["I1", "I2", "I3", f"U{i}"]), pick(["S1", "S2"]), "d", pick(["C1", "C2", "Unknown"]), pick(["UK", "FR"]), 2023, pick([1, 2]),
             pick(["Monday", "Friday"]), pick([Decimal("1.50"), Decimal("-2.25")]), float(i % 7), datetime(2023, 1, 1 + i % 28), pick(["x", "y"]))
            for i in range(400)]
    df = spark.createDataFrame(data, "InvoiceNo string, StockCode string, Description string, CustomerID string, Country string, Year int, Month int, "
                                     "Weekday string, Revenue decimal(38,6), Quantity double, InvoiceDate timestamp_ntz, Shop string")
    for by in ([], ["Shop"]):
        monkeypatch.setattr(grains, "ROWS_A_TASK", 10 if by else 1_000_000)  # dealt out, or as read
        g = Grains(df, by)
        assert g._dealt().rdd.getNumPartitions() == 40 or not by
        assert "LogicalRDD" not in g.rows._jdf.queryExecution().optimizedPlan().toString()  # the rows are made once
        for name, keys in GRAINS.items():
            cols = [c for c in ("rev", "valued", "n", "qty", "tx", "first", "last") if c in g._grain(name).columns]
            want = df.groupBy(*by, *keys).agg(F.sum("Revenue").alias("rev"), F.count("Revenue").alias("valued"), F.count(F.lit(1)).alias("n"),
                                              F.sum("Quantity").alias("qty"), F.count_distinct("InvoiceNo").alias("tx"),
                                              F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last")).select(*by, *keys, *cols)
            assert sorted(map(str, map(tuple, g._grain(name).select(*by, *[f"g_{k}" for k in keys], *cols).collect()))) == sorted(map(str, map(tuple, want.collect()))), name
    assert Grains(df.limit(0))._grain("total").count() == 0


def test_grains_deal_rows_by_their_number(spark, monkeypatch):
    """Few shuffle partitions leave no task with many groups, and rows without an invoice do not meet in one task."""
    from datetime import datetime
    from decimal import Decimal

    from tillroll.plans import grains
    from tillroll.plans.grains import Grains

    data = [(None if i % 3 == 0 else f"I{i // 2}", f"S{i % 50}" if i % 3 else "S", "d", f"C{i % 40}", "UK", 2023, 1, "Monday", Decimal("1.50"), 2.0, datetime(2023, 1, 1))
            for i in range(3000)]
    df = spark.createDataFrame(data, "InvoiceNo string, StockCode string, Description string, CustomerID string, Country string, Year int, Month int, "
                                     "Weekday string, Revenue decimal(38,6), Quantity double, InvoiceDate timestamp_ntz").repartition(3)
    monkeypatch.setattr(grains, "ROWS_A_TASK", 50)
    monkeypatch.setattr(grains, "ROWS_A_SHARE", 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        g = Grains(df)
        for keys in (["g_StockCode", "g_Description"], ["g_CustomerID"]):
            read = g._dealt(g.rows, keys).groupBy(F.spark_partition_id().alias("p")).count()
            assert read.agg(F.sum("count"), F.max("count") < 250).first() == (3000, True)
            groups = g._per_invoice(g.rows, keys, F.count(F.lit(1)).alias("n"))
            assert groups.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 150
        made = {r.g_StockCode: (r.rev, r.qty, r.tx) for r in g._grain("product").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = df.groupBy("StockCode").agg(F.sum("Revenue"), F.sum("Quantity"), F.count_distinct("InvoiceNo")).collect()
    assert made == {r[0]: tuple(r[1:]) for r in want} and g._grain("total").first().n == 3000


def test_sales_join_deals_lines_by_their_number(spark, monkeypatch):
    from tillroll.sources import fixtures

    sf = "/root/testdata/sf0.001"
    before = sorted(map(str, fixtures.sales(spark, sf, keyed=True).collect()))
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 300)
    tasks = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 300)
    dealt = fixtures.sales(spark, sf, keyed=True)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {tasks}") >= 2 and plan.count("RepartitionByExpression") == 2, plan
    assert sorted(map(str, dealt.collect())) == before and len(before) > 300 * 8


def test_sales_join_sorts_no_lines_by_part_nor_orders_by_customer(spark, monkeypatch):
    from tillroll.sources import fixtures

    sf, name = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    want = sorted(map(str, fixtures.sales(spark, sf).collect()))
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 300)
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as if parts and customers were too many to broadcast
    try:
        for few, sent, hashed in ((10, 1, 2), (100_000, 2, 1)):
            monkeypatch.setattr(fixtures, "ROWS_TO_SEND", few)
            df = fixtures.sales(spark, sf)
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert [plan.count(f"{kind} [") for kind in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")] == [1, sent, hashed], plan
            assert sorted(map(str, df.collect())) == want
    finally:
        spark.conf.set(name, before)
