"""The registered corpus queries: one per operator, over its whole intended table."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (bitpack, chat_format, decontaminate, hard_negatives, html_extract, jaccard_join, packing, quality_rules,
                          quality_trees, resampling, sharding, suffix_dedup, toxicity)
from tillroll.llm.common import read, shared_path

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.sql("""SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'),
        (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)""")
    return chat_format.digest(chat_format.format_records(chat_format.records_from_turns(rows.unionByName(probe))))


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file())


@query
def op10_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, model = shared_path(spark, "token-blocks"), tokenizer_file()
    bitpack.write_blocks(documents(spark, sf_dir), path, model, bitpack.vocabulary_size(model))
    return bitpack.read_documents(spark.read.parquet(path))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE["op4_quality_rules"] = quality_rules.ORACLE_SQL


@query
def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_trees.score(docs, quality_trees.train(docs, read(spark, sf_dir, "labels")))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels"))).drop("spans")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.report(decontaminate.decontaminate(documents(spark, sf_dir), items))


@query
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(documents(spark, sf_dir))


@query
def op8_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


@query
def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), read(spark, sf_dir, "benchmark", "text"))


ORACLE["op11_importance_resample"] = resampling.ORACLE_SQL


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), F.col("id") % 100 == 0, label=label)


ORACLE["op13_hard_negatives"] = hard_negatives.ORACLE_SQL


@query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("spans")
