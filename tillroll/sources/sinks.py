"""Sinks: typed, nested JSON documents of metrics and insights, and the run history.

The documents have struct schemas derived from the metric list, so numbers stay numbers in the files; the same schemas read
them back. Maps hold the keyed figures (months, top customers); their sizes are bounded by the metric list (top-k lists,
months of the calendar), never by the row count.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.plans.metrics import SPEC

INSIGHT_FIELDS = "position bigint, title string, description string, impact string, category string, confidence double, recommendation string"


def _entry_type(values: Sequence[str], texts: Sequence[str]) -> T.DataType:
    """A keyed figure: a number if the group has one metric, else a struct of its metrics."""
    if len(values) == 1 and not texts:
        return T.DoubleType()
    return T.StructType([T.StructField(m, T.DoubleType()) for m in values] + [T.StructField(m, T.StringType()) for m in texts])


def _sections() -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for section, group, _, key, values, texts in SPEC:
        out.setdefault(section, []).append((group, key, values, texts))
    return out


def metrics_schema(by: Sequence[str] = ()) -> T.StructType:
    """Schema of a metrics document: the business keys (as text), then one struct per section."""
    fields = [T.StructField(k, T.StringType()) for k in by]
    for section, parts in _sections().items():
        inner = []
        for group, key, values, texts in parts:
            plain = [T.StructField(m, T.DoubleType()) for m in values] + [T.StructField(m, T.StringType()) for m in texts]
            if group is None:
                inner += plain
            elif key is None:
                inner.append(T.StructField(group, T.StructType(plain)))
            else:
                inner.append(T.StructField(group, T.MapType(T.StringType(), _entry_type(values, texts))))
        fields.append(T.StructField(section, T.StructType(inner)))
    return T.StructType(fields)


def metrics_documents(long_df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One nested document per business from the long metrics table."""
    def name(group: str | None, metric: str) -> str:
        return f"{group}.{metric}" if group else metric

    def one(section: str, group: str | None, metric: str, kind: str) -> Column:
        here = (F.col("section") == section) & (F.col("metric") == name(group, metric)) & (F.col("key") == "")
        return F.max(F.when(here, F.col(kind))).alias(metric)

    def keyed(section: str, group: str, values: Sequence[str], texts: Sequence[str]) -> Column:
        kinds = {**{m: "value" for m in values}, **{m: "text" for m in texts}}
        of = F.when((F.col("section") == section) & F.col("metric").isin(*[name(group, m) for m in kinds]),
                    F.struct("key", "metric", "value", "text"))
        found = F.collect_list(of)  # nulls are left out; bounded by the metric list
        keys = F.array_distinct(F.transform(found, lambda e: e["key"]))

        def pick(k: Column, m: str, kind: str) -> Column:
            return F.filter(found, lambda e: (e["key"] == k) & (e["metric"] == name(group, m)))[0][kind]

        if len(kinds) == 1:
            entry = lambda k: pick(k, values[0], "value")
        else:
            entry = lambda k: F.struct(*[pick(k, m, kind).alias(m) for m, kind in kinds.items()])
        return F.map_from_arrays(keys, F.transform(keys, entry)).alias(group)

    sections = []
    for section, parts in _sections().items():
        inner = []
        for group, key, values, texts in parts:
            plain = [one(section, group, m, "value") for m in values] + [one(section, group, m, "text") for m in texts]
            inner += plain if group is None else [F.struct(*plain).alias(group)] if key is None else [keyed(section, group, values, texts)]
        sections.append(F.struct(*inner).alias(section))
    return long_df.groupBy(*by).agg(*sections).select(*[F.col(k).cast("string").alias(k) for k in by], *_sections())


def metrics_rows(documents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The long metrics table of documents, without empty figures (the inverse of :func:`metrics_documents`)."""
    items = []

    def item(section: str, metric: str, key: Column, value: Column | None, text: Column | None) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), key.alias("key"),
                        (F.lit(None) if value is None else value).cast("double").alias("value"),
                        (F.lit(None) if text is None else text).cast("string").alias("text"))

    for section, parts in _sections().items():
        for group, key, values, texts in parts:
            kinds = {**{m: True for m in values}, **{m: False for m in texts}}
            for m, number in kinds.items():
                metric = f"{group}.{m}" if group else m
                if key is None:
                    c = F.col(f"{section}.{metric}")
                    items.append(F.array(item(section, metric, F.lit(""), *((c, None) if number else (None, c)))))
                else:
                    entries = F.map_entries(F.col(f"{section}.{group}"))
                    items.append(F.transform(entries, _entry_item(item, section, metric, m, number, len(kinds) == 1)))
    rows = documents.select(*by, F.inline(F.flatten(F.array(*items))))
    return rows.where(F.col("value").isNotNull() | F.col("text").isNotNull())


def _entry_item(item: Callable, section: str, metric: str, field: str, number: bool, single: bool) -> Callable[[Column], Column]:
    def one(e: Column) -> Column:
        c = e["value"] if single else e["value"][field]
        return item(section, metric, e["key"], *((c, None) if number else (None, c)))
    return one


def insights_documents(insights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One document per business with its insights in order (at most four each)."""
    fields = [f.split()[0] for f in INSIGHT_FIELDS.split(", ")]
    return (insights.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("insights"))
            .select(*[F.col(k).cast("string").alias(k) for k in by], "insights"))


def insights_schema(by: Sequence[str] = ()) -> str:
    return ", ".join([*(f"`{k}` string" for k in by), f"insights array<struct<{INSIGHT_FIELDS.replace(' ', ':').replace(',:', ',')}>>"])


def insight_rows(documents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return documents.select(*by, F.inline("insights"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; figures without a value are left out."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Documents back with their types; a document that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_history(df: DataFrame, root: str, table: str, partition: str = "dataset_id") -> None:
    """Append records to ``root/table`` without versions (Parquet, partitioned by dataset id). :class:`History` keeps versions."""
    df.write.mode("append").partitionBy(partition).parquet(f"{root.rstrip('/')}/{table}")


def read_history(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{table}")
