import os
import tempfile

from pyspark.sql import functions as F

from tillroll.operators.clean import clean
from tillroll.sources.fixtures import dirty
from tillroll.streaming import uploads


def test_upload_stream_processes_each_file_as_a_dataset(spark):
    root = tempfile.mkdtemp(prefix="tillroll-stream-")
    src = dirty(spark, "/root/testdata/sf0.001")
    parts = {"north.csv": src.where(F.col("Country").isin("NATION_1", "NATION_2")),
             "south.csv": src.where(~F.col("Country").isin("NATION_1", "NATION_2") | F.col("Country").isNull())}
    os.makedirs(f"{root}/in")
    for name, df in parts.items():
        tmp = f"{root}/stage-{name}"
        df.coalesce(1).write.option("header", True).csv(tmp)
        part = [f for f in os.listdir(tmp) if f.endswith(".csv")][0]
        os.rename(f"{tmp}/{part}", f"{root}/in/{name}")
    q = uploads.start(spark, f"{root}/in", f"{root}/history", f"{root}/ckpt", available_now=True, on_error="clean")
    q.awaitTermination(600)
    assert q.exception() is None
    ds = {r.dataset_id: r.cleaned_rows for r in spark.read.parquet(f"{root}/history/datasets").collect()}
    from tillroll.sources.files import read_csv
    expect = {name: clean(read_csv(spark, f"{root}/in/{name}")).count() for name in parts}
    assert ds == expect
    ins = spark.read.parquet(f"{root}/history/insights")
    assert sorted(r.dataset_id for r in ins.select("dataset_id").distinct().collect()) == sorted(parts)
    met = spark.read.parquet(f"{root}/history/dataset_metrics")
    assert met.where("section = 'summary' AND metric = 'total_revenue'").count() == 2
