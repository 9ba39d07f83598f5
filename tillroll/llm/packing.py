"""Length buckets with the least padding, and batches under a token budget inside each bucket.

1. Every document's number of tokens is counted (whole texts, with the end id).
2. The global histogram over candidate lengths (a relative grid of 1/128, exact up to 256; at most some
   3,000 candidates whatever the corpus) goes to the driver, and dynamic programming finds the boundaries
   that minimise the padding of all documents to their bucket's upper boundary.
3. A bucket's documents are dealt by a hash into groups of about ``GROUP_DOCS``, so a bucket that holds a
   third of all rows is many groups; a group's documents fill batches of ``budget // boundary`` documents.
   At most the last batch of a group is not full.

Defined results: a null or empty text has one token (the end id); a document longer than the budget makes
a batch of its own; repeated rows are separate members; an empty table gives no rows. Extra columns are
ignored. Rows equal in id and text share a group, as nothing tells them apart.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import store, text_slices
from tillroll.llm.tokens import encoder

BUCKETS = 16
TOKEN_BUDGET = 32_768
GROUP_DOCS = 20_000
GRID = 128


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, mark`` (``mark``: hash of the text); the end id counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for piece in text_slices(batches):
            _, sizes = encode(piece.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes + 1, pa.int64()), piece.column(2)],
                                             names=["doc_id", "n_tokens", "mark"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(
        run, "doc_id long, n_tokens long, mark long")


def candidate(length: Column) -> Column:
    """The smallest candidate length that holds ``length``: steps of at most 1/128 of it."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(length)) - 9, F.lit(0)))
    return (F.ceil(length / step) * step).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` runs of the sorted candidate ``lengths`` with the least
    padding ``sum(boundary * count - total)``. O(buckets * candidates^2), vectorised."""
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    t = np.concatenate([[0], np.cumsum(totals)]).astype(np.float64)
    # cost[i, j]: candidates i..j-1 padded to lengths[j-1]
    cost = lengths[None, :] * (c[None, 1:] - c[:-1, None]) - (t[None, 1:] - t[:-1, None])
    cost = np.where(np.arange(n)[:, None] <= np.arange(n)[None, :], cost, np.inf)
    best, cuts = cost[0].copy(), []
    for _ in range(min(buckets, n) - 1):
        whole = np.concatenate([[np.inf], best[:-1]])[:, None] + cost
        cut = whole.argmin(axis=0)
        new = whole[cut, np.arange(n)]
        cuts.append(np.where(new < best, cut, -1))
        best = np.minimum(new, best)
    out, j = [], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            out.append(j)
            j = int(cut[j]) - 1
    out.append(j)
    return [int(lengths[k]) for k in reversed(out)]


def boundaries(counted: DataFrame, buckets: int = BUCKETS) -> tuple[list[int], list[int]]:
    """Bucket boundaries and the number of documents in each bucket."""
    hist = (counted.groupBy(candidate(F.col("n_tokens")).alias("c"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).orderBy("c").collect())
    lens = np.array([r["c"] for r in hist], np.int64)
    counts, totals = (np.array([r[k] for r in hist], np.float64) for k in ("n", "t"))
    ups = best_boundaries(lens, counts, totals, buckets)
    which = np.searchsorted(np.array(ups, np.int64), lens)
    return ups, np.bincount(which, counts, len(ups)).astype(int).tolist() if ups else []


def pack(counted: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET,
         group_docs: int = GROUP_DOCS) -> DataFrame:
    """``doc_id, n_tokens, bucket, padded_to, batch, batch_slot, batch_docs`` per row of ``counted``."""
    ups, sizes = boundaries(counted, buckets)
    longs = lambda v: F.array(*[F.lit(int(x)).cast("long") for x in v]) if v else F.array().cast("array<long>")
    bucket = sum(((F.col("n_tokens") > u).cast("int") for u in ups[:-1]), F.lit(0))
    spread = F.get(longs([-(-n // group_docs) for n in sizes]), F.col("bucket"))
    mix = F.xxhash64("doc_id", "mark")
    dealt = (counted.withColumn("bucket", bucket)
             .withColumn("padded_to", F.get(longs(ups), F.col("bucket")))
             .withColumn("_fit", F.greatest(F.floor(F.lit(budget) / F.col("padded_to")), F.lit(1)))
             .withColumn("_group", F.pmod(mix, spread)))
    order = Window.partitionBy("bucket", "_group").orderBy(mix, "doc_id", "mark", "n_tokens")
    placed = dealt.withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(
        Window.partitionBy("bucket", "_group")))
    number = F.floor(F.col("_r") / F.col("_fit"))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "padded_to",
        F.concat_ws("-", "bucket", "_group", number).alias("batch"),
        F.pmod("_r", "_fit").cast("int").alias("batch_slot"),
        F.least(F.col("_fit"), F.col("_n") - number * F.col("_fit")).cast("int").alias("batch_docs"))


def pack_documents(docs: DataFrame, tokenizer: str, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    return pack(store(count_tokens(docs, tokenizer), "token-counts"), buckets, budget)
