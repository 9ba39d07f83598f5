"""Corpus pipeline: toxic and low-quality documents go, one document of each near-duplicate class stays,
documents with benchmark passages go, and what is left is packed into token batches.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the
next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import decontaminate as leaks
from tillroll.llm import jaccard_join, packing, quality_trees, toxicity
from tillroll.llm.common import keep_rows, read, store, text_slices
from tillroll.llm.queries import tokenizer_file


SHINGLE, PERCENT = 5, 80  # the limits of the near-duplicate stage; those of the op9 query are its own


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return keep_rows(docs, model, lambda m, texts: m.scores(texts.to_pylist()) < 0.3)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_trees.train(docs, read(spark, sf_dir, "labels"))
    return keep_rows(docs, model, lambda m, texts: m.score(quality_trees.features(texts)) >= 0.5)


def free_name(docs: DataFrame) -> str:
    """A column name that the caller's columns do not have, in any spelling."""
    taken, name = {c.lower() for c in docs.columns}, "_key"
    while name in taken:
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: of its smallest id, or without an id if no row of the class has one. Classes are
    of rows, whatever their ids. Rows that are equal in id and text are one row; those without words are in no class."""
    text = F.coalesce(F.concat(F.lit("="), "text"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text)))
    classes = jaccard_join.row_classes(docs.select("doc_id", "text", key.alias("key")), SHINGLE, PERCENT)
    own = free_name(docs)
    each = store(classes.groupBy("class", "key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")), "class-keys")
    # Stored, so that Spark can split a large class in the join.
    kept = store(each.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("first")), "class-firsts")
    stays = F.col("key") == F.col("first")
    doubtful = store(each.join(kept, "class").where(~stays | (F.col("rows") > 1)).select(F.col("key").alias(own), stays.alias("stays")), "near-copies")
    # Most texts are in no class with others and stay where they are. Repeats of a row go in the tasks that
    # read them first, so that they do not meet in one task.
    some, others = jaccard_join.split(docs.withColumn(own, key), own, doubtful)
    some = some.dropDuplicates([own]).join(doubtful.where(~F.col("stays")), own, "left_anti")
    return some.select(docs.columns).unionByName(others.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row goes by its own text; only rows that are equal in id and text go together."""
    found = leaks.decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))
    own = free_name(docs)
    bad = found.where(F.size("spans") > 0).select(F.col("key").alias(own)).distinct()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            at = [piece.column(piece.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text")]
            yield piece.append_column(own, pa.array(map(leaks.row_key, *at), pa.binary()))

    rows = docs.mapInArrow(keyed, T.StructType(docs.schema.fields + [T.StructField(own, T.BinaryType())]))
    return rows.join(bad, own, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_low_quality), ("n-gram jaccard join", drop_near_duplicates),
          ("benchmark decontamination", drop_contaminated), ("packing", pack)]

# Models and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
