"""Helpers shared by the corpus operators: table access, shared storage, Arrow batch slicing and
the bounded labelled sample that classifiers are fitted on."""

from __future__ import annotations

import uuid
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import ensure_checkpoint_dir

# Text that one step of a Python task works on at a time. Texts are never cut: a longer text
# makes a slice of its own.
SLICE_BYTES = 2 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back. The lineage is cut
    and a lost executor loses nothing. Shuffle files go when the table is written, not when the driver's
    JVM happens to collect its garbage."""
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        ends = np.cumsum(byte_lengths(col))
        start, base = 0, 0
        while start < len(col):
            stop = max(int(np.searchsorted(ends, base + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def byte_offsets(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[col.offset:col.offset + len(col) + 1].astype(np.int64)


def byte_lengths(col: pa.Array) -> np.ndarray:
    return np.diff(byte_offsets(col))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the offsets of the texts (null: empty)."""
    off = byte_offsets(col)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves remainder ``part``; a null id is not held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % parts == part, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, parts: int, part: int, max_docs: int) -> DataFrame:
    """At most ``max_docs`` (documented bound) labelled ids that are not held out, in the order of a
    hash of the id, so that they are a random sample. Contradicting labels of an id count as 1."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", parts, part))
    return (usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))


def keep_rows(docs: DataFrame, model, judge: Callable[[object, pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text passes ``judge(model, texts)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            texts = piece.column(piece.schema.get_field_index("text"))
            yield piece.filter(pa.array(judge(shared.value, texts)))

    return docs.mapInArrow(run, docs.schema)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``rank`` (long, from 1) in the total order ``order``. Range partitions are sorted and stored once, each row
    with its place in its partition; the rows before a partition are a sum over one row per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(np.arange(seen + 1, seen + 1 + batch.num_rows))
            yield batch.append_column("_part", pa.array(np.full(batch.num_rows, part))).append_column("_place", places)
            seen += batch.num_rows

    fields = df.schema.fields + [T.StructField("_part", T.LongType()), T.StructField("_place", T.LongType())]
    placed = store(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, T.StructType(fields)), name)
    sums = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per writing task, so the broadcast is bounded by the number of shuffle partitions.
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_place")).alias("rank"))
