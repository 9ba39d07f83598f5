import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tillroll.operators import validate as V
from tillroll.schema import RAW_TEXT_SCHEMA
from tillroll.sources import files as S
from tillroll.sources.sample import sample_transactions


def test_sample_shape(spark):
    df = sample_transactions(spark, 10000)
    s = df.agg(F.count("*").alias("n"), F.count_if(F.col("Quantity") < 0).alias("ret"),
               F.count_if(F.col("CustomerID").isNull()).alias("nulls"),
               F.count_distinct("Country").alias("countries"), F.min("InvoiceDate").alias("lo"),
               F.max("InvoiceDate").alias("hi")).first()
    assert s.n == 10000 and s.ret == 200 and s.nulls == 500 and s.countries == 7
    assert str(s.lo).startswith("2023-01-01") and str(s.hi).startswith("2023-12-31")
    rep = {r.code for r in V.report(df).collect()}
    assert "negative_quantity" in rep and not any(c.endswith("all_null") for c in rep)


def test_missing_columns_and_empty(spark):
    df = spark.createDataFrame([("1", 2.0)], "InvoiceNo string, Quantity double")
    miss = {r.column for r in V.missing_columns(df).collect() if not r.present}
    assert miss == {"StockCode", "Description", "InvoiceDate", "UnitPrice", "CustomerID", "Country"}
    rep = V.report(df).collect()
    assert any(r.code == "missing_columns" and r.message.startswith("Missing required columns") for r in rep)
    assert V.is_valid(V.report(df)).first().is_valid is False
    empty = spark.createDataFrame([], RAW_TEXT_SCHEMA)
    r = V.report(empty).collect()
    assert [(x.code, x.message) for x in r] == [("empty", "File contains no data")]


def test_negative_price_is_error(spark):
    df = spark.createDataFrame([("I", "S", "d", "1", "01/01/2023 00:00", "-5", "C", "UK")], RAW_TEXT_SCHEMA)
    assert V.is_valid(V.report(df)).first().is_valid is False


def test_csv_roundtrip_and_encoding(spark):
    d = tempfile.mkdtemp(prefix="tillroll-test-")
    rows = [("INV1", "S1", "Café crème", "2", "01/02/2023 10:00", "1.50", "C1", "France"),
            ("INV2", "S2", "Naïve", "3", "02/02/2023 11:00", "2.00", "C2", "España")]
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/a.csv", "w", encoding="utf-8") as f:
        f.write(",".join(RAW_TEXT_SCHEMA.names) + "\n" + ",".join(rows[0]) + "\n")
    with open(f"{d}/in/b.csv", "w", encoding="latin-1") as f:
        f.write(",".join(RAW_TEXT_SCHEMA.names) + "\n" + ",".join(rows[1]) + "\n")
    enc = {os.path.basename(r.file): r.utf8 for r in S.file_encodings(spark, f"{d}/in").collect()}
    assert enc == {"a.csv": True, "b.csv": False}
    got = sorted(tuple(r) for r in S.read_csv_auto(spark, f"{d}/in").collect())
    assert got == sorted(rows)
    assert S.read_csv_auto(spark, f"{d}/in").columns == RAW_TEXT_SCHEMA.names
    with pytest.raises(ValueError, match="Unsupported file type"):
        S.load_file(spark, f"{d}/test.txt")
    assert S.load_or_sample(spark, f"{d}/missing.csv", 100).count() == 100


def upload(folder, name, *lines, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding) as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_csv_columns_go_by_header_name(spark):
    d = tempfile.mkdtemp(prefix="tillroll-test-")
    short = upload(d, "my short sales.csv", "Country,InvoiceNo,Näme", "UK,I1,é", encoding="utf-8-sig")
    got = S.load_file(spark, short)
    assert got.columns == ["Country", "InvoiceNo", "Näme"] and [tuple(r) for r in got.collect()] == [("UK", "I1", "é")]
    assert any(r.code == "missing_columns" for r in V.report(got).collect())
    # An index column without a name, as data frames are often exported.
    index = S.load_file(spark, upload(d, "index.csv", ",Quantity,Country", "0,5,España", encoding="latin-1"))
    assert index.columns[1:] == ["Quantity", "Country"] and index.first()[1:] == ("5", "España")


def test_csv_files_of_another_header_are_refused(spark):
    d = tempfile.mkdtemp(prefix="tillroll-test-")
    upload(d, "a.csv", "InvoiceNo,Country", "I1,UK")
    upload(d, "b.csv", "Country,InvoiceNo", "UK,I1")
    with pytest.raises(Exception, match="header"):
        S.read_csv(spark, d).collect()


def test_encoding_decision_moves_no_rows(spark, tmp_path):
    from tillroll.sources import files as S
    (tmp_path / "a.csv").write_bytes("Name,Note\nzoë,1\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("Name,Note\nzoë,2\n".encode("latin-1"))
    df = S.read_csv_auto(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("zoë", "1"), ("zoë", "2")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert S.path_exists(spark, str(tmp_path)) and not S.path_exists(spark, str(tmp_path / "none"))
