import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tillroll.operators import validate as V
from tillroll.plans import upload_run
from tillroll.schema import RAW_TEXT_SCHEMA
from tillroll.sources.history import History
from tillroll.streaming import uploads

GOOD = [(f"I{i}", f"S{i % 4}", "thing", str(1 + i % 3), f"{1 + i % 27:02d}/0{1 + i % 3}/2023 10:00", "2.50", f"C{i % 5}", "uk") for i in range(40)]
BAD = [*GOOD[:10], ("I3", "S9", "thing", "1", "01/01/2023 10:00", "-1.00", "C1", "uk")]


def frame(spark, **datasets):
    rows = [(name, *r) for name, rows in datasets.items() for r in rows]
    return spark.createDataFrame(rows, "dataset_id string, " + ", ".join(f"{c} string" for c in RAW_TEXT_SCHEMA.names))


def test_gate_rejects_a_dataset_and_keeps_the_others(spark):
    r = upload_run.run(frame(spark, good=GOOD, bad=BAD), by=["dataset_id"])
    runs = {x.dataset_id: x for x in r.runs.collect()}
    assert runs["good"].status == "success" and runs["good"].cleaned_rows == 40 and runs["good"].metric_count > 30
    assert runs["bad"].status == "rejected" and runs["bad"].cleaned_rows == 0 and runs["bad"].errors == ["Found 1 rows with negative prices"]
    assert {x.dataset_id for x in r.cleaned.select("dataset_id").distinct().collect()} == {"good"}
    q = r.quarantine.collect()
    assert len(q) == len(BAD) and {x.dataset_id for x in q} == {"bad"} and q[0].errors == ["Found 1 rows with negative prices"]
    assert {x.dataset_id for x in r.insights.collect()} == {"good"} and {x.dataset_id for x in r.metrics.collect()} == {"good"}
    final = r.cleaning_report.where("step = 'summary' AND stat = 'final_rows'").collect()
    assert [(x.dataset_id, x.value) for x in final] == [("good", 40.0)]
    r.release()


def test_gate_without_keys(spark):
    r = upload_run.run(frame(spark, bad=BAD).drop("dataset_id"))
    assert r.cleaned.count() == 0 and r.quarantine.count() == len(BAD) and r.runs.first().status == "rejected"
    r.release()
    r = upload_run.run(frame(spark, bad=BAD).drop("dataset_id"), on_error="clean")
    assert r.cleaned.count() == 10 and r.quarantine.count() == 0 and r.runs.first().status == "success"
    r.release()
    with pytest.raises(ValueError):
        upload_run.run(frame(spark, bad=BAD), on_error="ignore")


def test_validation_per_group(spark):
    got = V.report(frame(spark, good=GOOD, bad=BAD, twice=GOOD[:2] * 2), by=["dataset_id"]).collect()
    assert {(r.dataset_id, r.code, r["count"]) for r in got} == {("bad", "negative_price", 1), ("twice", "duplicate_rows", 2)}
    valid = {r.dataset_id: r.is_valid for r in V.is_valid(V.report(frame(spark, bad=BAD, twice=GOOD[:2] * 2), by=["dataset_id"]), ["dataset_id"]).collect()}
    assert valid == {"bad": False, "twice": True}


def test_commit_versions_and_replay(spark):
    h = History(spark, tempfile.mkdtemp(prefix="tillroll-versions-"))
    assert h.version() == 0
    r = upload_run.run(frame(spark, good=GOOD, bad=BAD), by=["dataset_id"])
    assert [upload_run.commit(r, h, "epoch-0") for _ in range(2)] == [1, 1]
    assert h.read("datasets").count() == 2 and h.read("dataset_metrics", dataset="bad").count() == 0
    assert h.read("quarantine", dataset="bad").count() == len(BAD)
    assert h.delete(spark.createDataFrame([("good",)], "dataset_id string")) == 2
    assert [x.dataset_id for x in h.read("datasets").collect()] == ["bad"] and h.read("dataset_metrics").count() == 0
    assert h.read("datasets", version=1).count() == 2 and h.read("dataset_metrics", version=1).count() > 30
    with pytest.raises(KeyError):
        h.read("nothing")
    r.release()


def test_stream_with_a_valid_and_an_invalid_file(spark):
    """Both files share invoice numbers; the invalid one is kept whole in the quarantine."""
    root = tempfile.mkdtemp(prefix="tillroll-gate-")
    os.makedirs(f"{root}/in")
    for name, rows in (("good.csv", GOOD), ("bad.csv", BAD)):
        with open(f"{root}/in/{name}", "w") as f:
            f.write("\n".join([",".join(RAW_TEXT_SCHEMA.names), *(",".join(r) for r in rows)]) + "\n")
    # Columns in another order, one more, and latin-1 text.
    with open(f"{root}/in/other.csv", "w", encoding="latin-1") as f:
        f.write("\n".join([",".join(["Note", *reversed(RAW_TEXT_SCHEMA.names)]), *(",".join(["x", *reversed([*r[:2], "caf\xe9", *r[3:]])]) for r in GOOD)]) + "\n")
    q = uploads.start(spark, f"{root}/in", f"{root}/history", f"{root}/ckpt", available_now=True)
    q.awaitTermination(600)
    assert q.exception() is None
    runs = {r.dataset_id: (r.status, r.cleaned_rows) for r in spark.read.parquet(f"{root}/history/datasets").collect()}
    assert runs == {"good.csv": ("success", 40), "bad.csv": ("rejected", 0), "other.csv": ("success", 40)}
    top = spark.read.parquet(f"{root}/history/dataset_metrics").where("dataset_id = 'other.csv' AND metric = 'top_products.Description'")
    assert {r.text for r in top.collect()} == {"caf\xe9"}
    kept = spark.read.parquet(f"{root}/history/quarantine")
    assert kept.count() == len(BAD) and kept.where(F.size("errors") == 1).count() == len(BAD)
    assert [r.dataset_id for r in spark.read.parquet(f"{root}/history/insights").select("dataset_id").orderBy("dataset_id").collect()] == ["good.csv", "other.csv"]
