"""Registered queries: sources and sinks (S). File round trips write to a fresh folder under
the session's reliable checkpoint directory (shared storage on a cluster)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.catalog import ORACLE, q_more, register  # noqa: F401  q_more fills ORACLE
from tillroll.catalog.bases import output, sql, tx
from tillroll.catalog.q_clean import CLEAN_COLS_SQL
from tillroll.operators import clean as C
from tillroll.operators import insights as I
from tillroll.operators import validate as V
from tillroll.plans.metrics import long_metrics
from tillroll.schema import REQUIRED_COLUMNS
from tillroll.session import ensure_checkpoint_dir
from tillroll.sources import files as S
from tillroll.sources import sinks as K
from tillroll.sources.fixtures import dirty
from tillroll.sources.history import History
from tillroll.sources.tables import table


def scratch(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/tillroll-scratch/{name}-{uuid.uuid4().hex}"


register("load_metadata", lambda s, d: (lambda t: t.agg(
    F.count(F.lit(1)).alias("rows_loaded"), F.lit(len(t.columns)).cast("bigint").alias("columns_loaded"),
    F.date_format(F.min("InvoiceDate"), "yyyy-MM-dd").alias("date_min"),
    F.date_format(F.max("InvoiceDate"), "yyyy-MM-dd").alias("date_max"),
    F.coalesce(F.timestamp_diff("DAY", F.min("InvoiceDate"), F.max("InvoiceDate")), F.lit(0)).cast("bigint").alias("days")))(
    C.prepare(dirty(s, d))),
    sql("prepared", """
SELECT count(*) AS rows_loaded, CAST(8 AS BIGINT) AS columns_loaded, strftime(min(InvoiceDate), '%Y-%m-%d') AS date_min,
  strftime(max(InvoiceDate), '%Y-%m-%d') AS date_max, coalesce(datesub('day', min(InvoiceDate), max(InvoiceDate)), 0) AS days
FROM prepared"""))

register("date_range", lambda s, d: tx(s, d).agg(
    F.date_format(F.min("InvoiceDate"), "yyyy-MM-dd").alias("min"),
    F.date_format(F.max("InvoiceDate"), "yyyy-MM-dd").alias("max"),
    F.coalesce(F.timestamp_diff("DAY", F.min("InvoiceDate"), F.max("InvoiceDate")), F.lit(0)).cast("bigint").alias("days")),
    sql("tx", """
SELECT strftime(min(InvoiceDate), '%Y-%m-%d') AS min, strftime(max(InvoiceDate), '%Y-%m-%d') AS max,
  coalesce(datesub('day', min(InvoiceDate), max(InvoiceDate)), 0) AS days FROM tx"""))

register("src_dispatch", lambda s, d: S.load_file(s, f"{d.rstrip('/')}/orders.parquet"), sql("none", "SELECT * FROM orders"))


def write_csv(df, path, encoding="UTF-8"):
    """CSV with header; blanks around values are kept."""
    (df.write.option("header", True).option("encoding", encoding)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def _csv(s, d):
    path = scratch(s, "dirty-csv")
    write_csv(dirty(s, d), path)
    return output(C.clean(S.read_csv(s, path)))


register("src_csv", _csv, sql("cleaned", f"SELECT {CLEAN_COLS_SQL} FROM cleaned"))


def _encodings(s, d):
    path = scratch(s, "conv csv")
    conv = table(s, d, "conversations", "conv_id", "turn", "role", "text")
    write_csv(conv.where(F.col("turn") % 2 == 0), f"{path}/utf8")
    write_csv(conv.where(F.col("turn") % 2 == 1), f"{path}/latin1", "ISO-8859-1")
    return S.read_csv_auto(s, path, multiline=True)


register("src_csv_encoding", _encodings, sql("none", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations"""))


def _csv_or_sample(s, d):
    """The file has its columns in reverse order and one more."""
    path, raw = scratch(s, "upload"), dirty(s, d)
    write_csv(raw.select(*reversed(raw.columns), F.lit("x").alias("Note")), f"{path}/my sales.csv")
    return S.load_or_sample(s, f"{path}/my sales.csv")


register("src_csv_or_sample", _csv_or_sample, sql("dirty", "SELECT *, 'x' AS Note FROM dirty"))


def _missing(s, d):
    path = scratch(s, "short-csv")
    write_csv(dirty(s, d).select("Country", "Quantity", "InvoiceNo"), path)
    loaded = S.read_csv(s, path)
    return V.missing_columns(loaded).crossJoin(F.broadcast(loaded.agg(F.count("InvoiceNo").alias("invoice_rows"))))


register("val_missing_columns", _missing, sql("dirty", f"""
SELECT c AS "column", c IN ('Country', 'Quantity', 'InvoiceNo') AS present, (SELECT count(InvoiceNo) FROM dirty) AS invoice_rows
FROM (SELECT unnest([{", ".join(repr(c) for c in REQUIRED_COLUMNS)}]) AS c)"""))
def _metrics_json(s, d):
    """Written to a file and read back with the schema of the metric list."""
    path = scratch(s, "metrics-json")
    K.write_json(K.metrics_documents(long_metrics(tx(s, d))), path)
    return K.metrics_rows(K.read_json(s, path, K.metrics_schema()))


def _insights_json(s, d):
    path = scratch(s, "insights-json")
    K.write_json(K.insights_documents(I.key_insights(I.insight_metrics(tx(s, d), ["Country"]), ["Country"]), ["Country"]), path)
    return K.insight_rows(K.read_json(s, path, K.insights_schema(["Country"])), ["Country"])


register("sink_metrics_json", _metrics_json, f"SELECT * FROM ({ORACLE['kpi_all']}) t WHERE value IS NOT NULL OR text IS NOT NULL")
register("sink_insights_json", _insights_json, ORACLE["ins_key_insights_by_country"])


def _runs(s, d):
    """Two batches of runs (customers) with their metric records (orders); the first one is written twice, as by a replay,
    and one run in seven is deleted afterwards."""
    h = History(s, scratch(s, "history"))
    runs = table(s, d, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("dataset_id"), F.col("c_acctbal").cast("double").alias("amount"))
    records = table(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").cast("double").alias("amount"))
    for batch in (0, 1, 0):
        h.append({"datasets": runs.where(F.col("dataset_id") % 2 == batch), "dataset_metrics": records.where(F.col("dataset_id") % 2 == batch)},
                 f"batch-{batch}")
    h.delete(runs.where("dataset_id % 7 = 0"))
    return h


def _history(s, d):
    return _runs(s, d).read("dataset_metrics").select("dataset_id", "record_id", "amount")


def _history_versions(s, d):
    h = _runs(s, d)
    parts = [h.read(t, v).groupBy(F.lit(v).cast("bigint").alias("version"), F.lit(t).alias("table")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("dataset_id").alias("datasets"))
        for v in range(1, h.version() + 1) for t in ("datasets", "dataset_metrics")]
    return reduce(DataFrame.unionByName, parts)


register("sink_history", _history, """
SELECT o_custkey AS dataset_id, o_orderkey AS record_id, CAST(o_totalprice AS DOUBLE) AS amount FROM orders WHERE o_custkey % 7 <> 0""")
register("sink_history_versions", _history_versions, """
WITH v AS (SELECT unnest([1, 2, 3]) AS version),
r AS (SELECT 'datasets' AS "table", c_custkey AS id FROM customer UNION ALL SELECT 'dataset_metrics', o_custkey FROM orders)
SELECT CAST(version AS BIGINT) AS version, "table", count(*) AS records, count(DISTINCT id) AS datasets
FROM v JOIN r ON (version > 1 OR id % 2 = 0) AND (version < 3 OR id % 7 <> 0) GROUP BY ALL""")
