"""The studied service's upload flow as one Spark run: validate -> gate -> clean -> KPIs -> health
-> insights -> history, for one dataset or for many at once (``by``).

A dataset whose validation has an error is rejected as a whole: it is not cleaned, and its rows go to the quarantine with
the errors, while the other datasets of the run go on. Raw and cleaned rows are persisted (MEMORY_AND_DISK: recomputed from
lineage if an executor is lost); validation, profile, aggregates and the metrics row are small stored tables, from which
all reports, metrics and insights are derived.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators import insights as I
from tillroll.operators import validate as V
from tillroll.operators.clean import RawProfile, clean
from tillroll.plans.grains import Grains
from tillroll.plans.metrics import long_metrics, metric_count
from tillroll.plans.report import clean_report
from tillroll.session import store as stored
from tillroll.sources import sinks
from tillroll.sources.history import History


@dataclass
class Run:
    by: list
    validation: DataFrame
    quarantine: DataFrame
    runs: DataFrame
    cleaned: DataFrame
    cleaning_report: DataFrame
    metrics: DataFrame
    insight_metrics: DataFrame
    insights: DataFrame
    key_insights: DataFrame
    persisted: list

    def release(self) -> None:
        for df in self.persisted:
            df.unpersist()


def gate(raw: DataFrame, rejected: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of accepted datasets, and rows of rejected ones with their ``errors``. Without ``by`` all rows are one dataset."""
    if not by:
        bad = raw.crossJoin(F.broadcast(rejected))
        return raw.join(F.broadcast(rejected.select(F.lit(True).alias("_bad"))), F.lit(True), "left_anti"), bad
    r = rejected.select(*[F.col(k).alias(f"_r_{k}") for k in by], "errors")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by])
    return raw.join(r, same, "left_anti"), raw.join(r, same).select(*raw.columns, "errors")


def run(raw: DataFrame, by: Sequence[str] = (), report: bool = True, on_error: str = "reject") -> Run:
    """Build every result of one upload run. The shared tables (validation, profile, aggregates, metrics row) are computed
    here, the rest when a result is used.

    ``by`` names dataset / business key columns of ``raw``: every step (validation, mode fill, thresholds, KPIs, insights)
    is then computed per key, for all keys in the same jobs. ``on_error="clean"`` cleans datasets with validation errors
    too, ``report=False`` leaves out the cleaning report (no rows).
    """
    if on_error not in ("reject", "clean"):
        raise ValueError(f"on_error is 'reject' or 'clean', not {on_error!r}")
    by = list(by)
    raw_p = raw.persist(StorageLevel.MEMORY_AND_DISK)
    validation = stored(V.report(raw_p, by=by), "validation")
    errors = V.rejected(validation, by) if by else V.rejected(validation, by).where(F.size("errors") > 0)
    accepted, quarantine = gate(raw_p, errors if on_error == "reject" else errors.limit(0), by)
    profile = RawProfile(accepted, by)
    cleaned = clean(accepted, by, profile=profile).persist(StorageLevel.MEMORY_AND_DISK)
    grains = Grains(cleaned, by, with_values=True)
    m = stored(I.insight_metrics(grains, by), "metrics-row")
    health = m.select(*by, "revenue_health", "customer_health", "product_health", "overall_health")
    metrics = stored(long_metrics(grains, by, health=health), "metrics")
    details = clean_report(accepted, by, profile=profile, cleaned=cleaned)
    return Run(by=by, validation=validation, quarantine=quarantine,
               runs=_records(raw_p, by, errors, on_error, grains, metrics),
               cleaned=cleaned, cleaning_report=details if report else details.limit(0),
               metrics=metrics, insight_metrics=m, insights=I.assemble(m, by), key_insights=I.key_insights(m, by),
               persisted=[cleaned, raw_p])


def _records(raw: DataFrame, by: Sequence[str], errors: DataFrame, on_error: str, grains: Grains, metrics: DataFrame) -> DataFrame:
    """One record per dataset: status, rows before and after, share removed, number of metrics, validation errors."""
    none = F.lit(None).cast("string")
    keys = [F.coalesce(F.col(k).cast("string"), none).alias(k) for k in by]

    def part(df: DataFrame, *columns: Column | str) -> DataFrame:
        return df.select(F.struct(*keys, F.lit(0)).alias("_key"), *columns)

    out = part(raw.groupBy(*by).agg(F.count(F.lit(1)).alias("original_rows")), *by, "original_rows")
    done = part(grains.rows_per_group(), F.col("n").alias("cleaned_rows"))
    counted = part(metric_count(metrics, by), "metric_count")
    bad = part(errors, "errors")
    for df in (done, counted, bad):
        # Null keys meet as parts of a struct.
        out = out.join(df.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k")
    rejected = F.col("errors").isNotNull() if on_error == "reject" else F.lit(False)
    zero = F.lit(0).cast("bigint")
    kept = F.when(rejected, zero).otherwise(F.coalesce("cleaned_rows", zero))
    return out.select(*by, F.when(rejected, "rejected").otherwise("success").alias("status"), "original_rows",
                      kept.alias("cleaned_rows"),
                      F.round(F.try_divide((F.col("original_rows") - kept) * 100.0, "original_rows"), 2).alias("rows_removed_percentage"),
                      F.when(rejected, zero).otherwise(F.coalesce("metric_count", zero)).alias("metric_count"),
                      F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def tables(r: Run, dataset_id: str | None = None) -> dict[str, DataFrame]:
    """The records of a run by table, keyed by ``dataset_id`` (given, or the key values joined by '/')."""
    ds = F.lit(dataset_id) if dataset_id or not r.by else F.concat_ws("/", *[F.col(k).cast("string") for k in r.by])

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_ds", ds).drop(*r.by).withColumnRenamed("_ds", "dataset_id")

    return {"datasets": keyed(r.runs), "dataset_metrics": keyed(r.metrics), "insights": keyed(r.insights),
            "key_insights": keyed(r.key_insights), "validation": keyed(r.validation),
            "cleaning_reports": keyed(r.cleaning_report), "quarantine": keyed(r.quarantine)}


def store(r: Run, root: str, dataset_id: str | None = None, by: Sequence[str] = (),
          batch: int | None = None) -> None:
    """Write the run's records to the history tables under ``root``.

    With ``batch`` (a stream's epoch) each table is partitioned by it and the partition is
    overwritten, so a batch replayed after a failure replaces its records instead of adding
    them twice. :func:`commit` keeps versions instead.
    """
    for name, df in tables(r, dataset_id).items():
        if batch is None:
            sinks.append_history(df, root, name)
        else:
            (df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch", "dataset_id").parquet(f"{root.rstrip('/')}/{name}"))


def commit(r: Run, history: History, batch: str | None = None, dataset_id: str | None = None) -> int:
    """All records of the run as one version of the history; a batch that is there already adds nothing."""
    return history.append(tables(r, dataset_id), batch or uuid.uuid4().hex)


def execute(actions: Sequence[Callable[[], None]], threads: int = 4) -> None:
    """Run independent sinks as concurrent Spark jobs (one driver thread each).

    Their plans share the persisted inputs; running them together keeps the executors busy
    while each job waits on its small stages. Errors are re-raised.
    """
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        for f in [pool.submit(a) for a in actions]:
            f.result()
