"""Hard negatives by exact integer products of anchor and candidate tiles (Strassen) and mergeable heaps.

Anchors are dealt into blocks of about ``ANCHOR_ROWS`` rows by a hash of a row number, every block meets every candidate.
A block's candidates are dealt again into slots, so that a few blocks use all tasks; each (block, slot) group streams
through one task: its anchors first, then its candidates in tiles of ``TILE_ROWS``. Nothing is broadcast or collected.

**Scores.** A component x counts as floor(256 x). A tile's scores are one int64 matrix product by Strassen's recursion: both
factors are padded with zeros to a multiple of the leaf, seven half-size products replace eight, and all additions are exact
modulo 2^64, so the scores are exact wherever the true ones fit a long.

**Heaps.** A tile's candidates are in id order, so a stable sort by score has the ties right. Each anchor keeps its best
``positives`` of its own label, and in a second pass over the tiles its best ``negatives`` of other labels inside each
positive's window ``low * p <= 100 * n <= high * p``. Heaps of tiles merge in the task, heaps of tasks by a ranked window that
Spark trims before its shuffle.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no part; vectors are
padded with zeros to the longest of a product, an empty vector scores 0; rows equal in id are separate rows, another row with
the anchor's id may be its positive, and rows equal in score and id are told apart by their row number; anchors without
positives or negatives give no rows, nor does an empty table. Extra columns are ignored. Scores beyond 2^56 overflow the
comparison of windows; components beyond 2^62 are held there.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import store
from tillroll.session import shuffle_partitions

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
ANCHOR_ROWS, TILE_ROWS = 1024, 1024
LEAF = 16
NONE = -(1 << 62)  # score of an empty place in a heap


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices, exact modulo 2^64."""
    (m, d), n = a.shape, b.shape[1]
    levels = max(0, (min(m, d, n) // LEAF).bit_length() - 1)
    unit = 1 << levels

    def padded(x: np.ndarray) -> np.ndarray:
        return np.pad(x, [(0, -s % unit) for s in x.shape])

    return _product(padded(a), padded(b), levels)[:m, :n]


def _product(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    down = levels - 1
    p1 = _product(a11 + a22, b11 + b22, down)
    p2 = _product(a21 + a22, b11, down)
    p3 = _product(a11, b12 - b22, down)
    p4 = _product(a22, b21 - b11, down)
    p5 = _product(a11 + a12, b22, down)
    p6 = _product(a21 - a11, b11 + b12, down)
    p7 = _product(a12 - a22, b21 + b22, down)
    out = np.empty((a.shape[0], b.shape[1]), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out


def number_rows(rows: DataFrame, vector: str, label: Column) -> DataFrame:
    """Stored ``tag, id, label, v`` of the rows that take part; ``tag`` is a number of the row, ``v`` its integers."""
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = (rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"),
                        F.col(vector).cast("array<double>").alias(vector))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            col = batch.column(2)
            whole = np.clip(np.floor(256.0 * col.flatten().to_numpy(zero_copy_only=False)), NONE, -NONE).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            tags = pa.array(np.arange(seen, seen + batch.num_rows))
            yield pa.RecordBatch.from_arrays([tags, batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(whole))],
                                             names=["tag", "id", "label", "v"])
            seen += batch.num_rows

    return store(kept.mapInArrow(run, "tag long, id long, label long, v array<long>"), "vectors")


def _tiles(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """Groups (block, slot): the block's anchors, then the slot's share of all rows in no set order. A slot has a tile of rows
    at least, as each one sends its own heaps."""
    blocks = -(-n_anchors // ANCHOR_ROWS)
    slots = min(-(-2 * shuffle_partitions(rows.sparkSession) // blocks), -(-n_rows // TILE_ROWS))
    left = anchors.select(F.pmod(F.xxhash64("tag"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
                          F.lit(0).alias("side"), "tag", "id", "label", "v", "found")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("tag", F.lit(1)), F.lit(slots)).cast("int").alias("slot"),
                        F.lit(1).alias("side"), "tag", "id", "label", "v", F.lit(None).cast("array<long>").alias("found"))
    key = [F.col("block"), F.col("slot")]
    return left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "side")


class Part:
    """Rows of one side: ``tag, id, label`` and the matrix of their vectors."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.tag, self.id, self.label = (table.column(c).to_numpy() for c in ("tag", "id", "label"))
        col = pa.concat_arrays(table.column("v").chunks)
        size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.v = np.zeros((len(size), int(size.max(initial=0))), np.int64)
        self.v[np.arange(self.v.shape[1])[None, :] < size[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
        self.found = table.column("found").to_pylist()

    def in_order(self) -> "Part":
        at = np.lexsort((self.tag, self.id))
        self.tag, self.id, self.label, self.v = self.tag[at], self.id[at], self.label[at], self.v[at]
        return self

    def scores(self, other: "Part") -> np.ndarray:
        wide = max(self.v.shape[1], other.v.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (self.v, other.v))
        return strassen(a, np.ascontiguousarray(b.T))


class Heap:
    """The best ``size`` (score, id, tag) of each group, as arrays whose last axis is in order."""

    def __init__(self, groups: tuple, size: int):
        self.size = size
        self.score = np.full((*groups, 0), NONE, np.int64)
        self.id, self.tag = np.zeros_like(self.score), np.zeros_like(self.score)

    def merge(self, score: np.ndarray, id_: np.ndarray, tag: np.ndarray) -> None:
        parts = [np.concatenate(x, -1) for x in ((self.score, score), (self.id, id_), (self.tag, tag))]
        first = np.lexsort((parts[2], parts[1], -parts[0]), axis=-1)[..., :self.size]
        self.score, self.id, self.tag = (np.take_along_axis(x, first, -1) for x in parts)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Part, Iterator[Part]]]:
    """Each group's anchors and its tiles of candidates. The rows of a group follow each other, anchors first."""
    pieces = _pieces(batches)
    piece = next(pieces, None)
    while piece is not None:
        key = piece[0][:2]
        anchors: list = []
        while piece is not None and piece[0] == (*key, 0):
            anchors.append(piece[1])
            piece = next(pieces, None)

        def tiles() -> Iterator[Part]:
            nonlocal piece
            held: list = []
            while piece is not None and piece[0] == (*key, 1):
                held.append(piece[1])
                piece = next(pieces, None)
                if sum(b.num_rows for b in held) >= TILE_ROWS or piece is None or piece[0] != (*key, 1):
                    yield Part(held).in_order()
                    held = []

        rest = tiles()
        if anchors:
            yield Part(anchors), rest
        for _ in rest:  # a group without anchors has nothing to do; of others nothing is left
            pass


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with one (block, slot, side), of at most ``TILE_ROWS`` rows."""
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            for at in range(int(start), int(stop), TILE_ROWS):
                yield tuple(keys[at].tolist()), batch.slice(at, min(TILE_ROWS, int(stop) - at))


def _best(anchors: Part, tiles: Iterator[Part], size: int) -> Heap:
    heap = Heap((len(anchors.tag),), size)
    for tile in tiles:
        same = (tile.label[None, :] == anchors.label[:, None]) & (tile.tag[None, :] != anchors.tag[:, None])
        score = np.where(same, anchors.scores(tile), NONE)
        first = np.argsort(-score, axis=1, kind="stable")[:, :size]
        heap.merge(np.take_along_axis(score, first, 1), tile.id[first], tile.tag[first])
    return heap


def _windows(anchors: Part, tiles: Iterator[Part], wide: int, size: int, low: int, high: int) -> tuple[np.ndarray, Heap]:
    """Best negatives in the window of each anchor's positives (score, id, tag, ... in ``found``)."""
    bound = np.full((len(anchors.tag), wide), NONE, np.int64)
    for i, f in enumerate(anchors.found):
        bound[i, :len(f) // 3] = f[::3]
    none = (bound == NONE)[..., None]
    at_least, at_most = np.where(none[..., 0], 0, bound * low), np.where(none[..., 0], 0, bound * high)
    heap = Heap(bound.shape, size)
    for tile in tiles:
        score = np.where(tile.label[None, :] != anchors.label[:, None], anchors.scores(tile), NONE)
        order = np.argsort(-score, axis=1, kind="stable")
        score = np.take_along_axis(score, order, 1)
        real = score != NONE
        hundred = np.where(real, score, 0) * 100
        begin = np.stack([(real & (hundred > at_most[:, w:w + 1])).sum(1) for w in range(wide)], 1)
        place = begin[..., None] + np.arange(size)
        inside = place < score.shape[1]
        flat = np.where(inside, place, 0).reshape(len(bound), -1)
        got, value, is_real = (np.take_along_axis(x, flat, 1).reshape(place.shape) for x in (score, hundred, real))
        inside &= is_real & (value >= at_least[..., None]) & ~none
        picked = np.take_along_axis(order, flat, 1).reshape(place.shape)
        heap.merge(np.where(inside, got, NONE), tile.id[picked], tile.tag[picked])
    return bound, heap


def _entries(heap: Heap, *group: np.ndarray) -> pa.RecordBatch:
    at = np.nonzero(heap.score != NONE)
    cols = [g[at[:-1]] for g in group] + [heap.score[at], heap.id[at], heap.tag[at]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f"c{i}" for i in range(len(cols))])


def _rank(df: DataFrame, group: list[str], size: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id", "tag")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(rows: DataFrame, is_anchor: Column, vector: str = "embedding", label: Column | None = None, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``is_anchor`` is a condition on ``id``."""
    rows = number_rows(rows, vector, F.col("label") if label is None else label)
    anchors = rows.where(is_anchor)
    n_anchors, n_rows = anchors.count(), rows.count()
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], _RESULT)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tiles in _groups(batches):
            yield _entries(_best(part, tiles, positives), part.tag).rename_columns(["anchor", "score", "id", "tag"])

    blank = F.array().cast("array<long>").alias("found")
    best = _tiles(anchors.select("*", blank), rows, n_anchors, n_rows).mapInArrow(first_pass, "anchor long, score long, id long, tag long")
    best = store(_rank(best, ["anchor"], positives), "positives")
    # At most ``positives`` rows an anchor.
    found = best.groupBy(F.col("anchor").alias("tag")).agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "score", "id", "tag"))), lambda r: F.array(r["score"], r["id"], r["tag"]))).alias("found"))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tiles in _groups(batches):
            bound, heap = _windows(part, tiles, positives, negatives, low, high)
            ids, tags = np.zeros_like(bound), np.zeros_like(bound)
            for i, f in enumerate(part.found):
                ids[i, :len(f) // 3], tags[i, :len(f) // 3] = f[1::3], f[2::3]
            wide = np.broadcast_to(part.id[:, None], bound.shape), np.broadcast_to(part.tag[:, None], bound.shape)
            yield _entries(heap, *wide, ids, tags, bound).rename_columns(
                ["anchor_id", "anchor", "positive_id", "positive", "positive_score", "score", "id", "tag"])

    near = _tiles(anchors.join(found, "tag"), rows, n_anchors, n_rows).mapInArrow(
        second_pass, "anchor_id long, anchor long, positive_id long, positive long, positive_score long, score long, id long, tag long")
    return _rank(near, ["anchor", "positive"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
