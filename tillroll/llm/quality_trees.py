"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a vector of statistics (shares of byte classes, word and line shapes, repetition),
computed with numpy over the bytes of an Arrow batch. Trees are grown level by level on histograms of
binned features and stored as complete binary trees in flat arrays, so that scoring is ``depth``
vectorised index steps for all rows and trees at once.

The fit takes at most ``FIT_DOCS`` labelled documents (a random sample in hash order; only their feature
vectors reach the driver). Scores come from whole texts alone.

Defined results: a null or empty text has the zero vector and the score of it; repeated rows score
alike; an empty table gives no rows; without labels of both classes the score is the share of label 1
(0.5 without any label). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import held_out, labelled_ids, text_bytes, text_slices

FIT_DOCS = 16_000
BINS, TREES, DEPTH, RATE, SMOOTH, LEAST = 64, 80, 4, 0.15, 1.0, 8

# Byte classes of UTF-8 text: 0 rest, 1 blank, 2 newline, 3 other white space, 4 lower, 5 upper, 6 digit,
# 7 sentence marks, 8 symbols, 9 exclamation and question marks, 10 first byte of a longer letter, 11 its rest.
CLASSES = 12
_CLASS = np.zeros(256, np.uint8)
for _k, _bytes in ((1, b" "), (2, b"\n"), (3, b"\t\r\x0b\x0c"), (4, bytes(range(97, 123))), (5, bytes(range(65, 91))),
                   (6, bytes(range(48, 58))), (7, b".,;:'\"()-"), (8, b"#*$%&|<>=_{}[]@\\/~^+"), (9, b"!?"),
                   (10, bytes(range(192, 256))), (11, bytes(range(128, 192)))):
    _CLASS[list(_bytes)] = _k

FEATURES = ["log_bytes", *(f"share_{k}" for k in range(CLASSES)), "log_words", "word_length", "symbol_ends", "mark_ends",
            "distinct_words", "top_word", "stutter", "repeated_pairs", "log_lines", "line_length", "repeated_lines",
            "short_words", "long_words"]


def _per_doc(keys: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(keys, minlength=n).astype(np.float64)


def _repeats(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Per document: how many values equal an earlier one of it."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    return _per_doc(d[1:][(d[1:] == d[:-1]) & (v[1:] == v[:-1])], n)


def _codes(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and dictionary code of all list items that are not empty."""
    sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy()
    flat = pc.list_flatten(parts)
    code = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(parts)), sizes)[filled], code[filled]


def features(texts: pa.Array) -> np.ndarray:
    """One row of :data:`FEATURES` per text."""
    n = len(texts)
    raw, off = text_bytes(texts)
    cls = _CLASS[raw]
    size = np.diff(off).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(off))
    count = np.bincount(doc * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    gap = (cls >= 1) & (cls <= 3)
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    ends = ~gap & np.concatenate([gap[1:] | edge[1:-1], [True]])[:len(gap)] if len(raw) else np.zeros(0, bool)
    words = _per_doc(doc[ends], n)
    one = np.maximum(words, 1)
    wdoc, wcode = _codes(pc.utf8_split_whitespace(pc.fill_null(texts, "")))
    same = (wdoc[1:] == wdoc[:-1]) & (wcode[1:] == wcode[:-1])
    stutter = _per_doc(wdoc[1:][same], n)
    pairs = wdoc[1:] == wdoc[:-1]
    pair = (wcode[1:] * (int(wcode.max(initial=0)) + 1) + wcode[:-1])[pairs]
    top = np.zeros(n)
    if len(wdoc):
        order = np.lexsort((wcode, wdoc))
        d, v = wdoc[order], wcode[order]
        starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
        np.maximum.at(top, d[starts], np.diff(np.concatenate([starts, [len(d)]])))
    starts_word = ~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1]) if len(raw) else np.zeros(0, bool)
    begins = np.flatnonzero(starts_word)
    wlen = np.flatnonzero(ends) - begins + 1
    ldoc, lcode = _codes(pc.split_pattern(pc.fill_null(texts, ""), "\n"))
    lines = _per_doc(ldoc, n)
    bdoc = doc[begins]
    cols = [np.log1p(size), *(count / np.maximum(size, 1)[:, None]).T, np.log1p(words), (size - count[:, 1:4].sum(1)) / one,
            _per_doc(doc[ends & (cls == 8)], n) / one, _per_doc(doc[ends & (cls == 9)], n) / one,
            (_per_doc(wdoc, n) - _repeats(wdoc, wcode, n)) / one, top / one, stutter / one, _repeats(wdoc[1:][pairs], pair, n) / one,
            np.log1p(lines), size / np.maximum(lines, 1), _repeats(ldoc, lcode, n) / np.maximum(lines, 1),
            _per_doc(bdoc[wlen <= 2], n) / one, _per_doc(bdoc[wlen >= 25], n) / one]
    return np.stack(cols, axis=1).astype(np.float32)


# ------------------------------------------------------------------------------------- trees
@dataclass
class Forest:
    """Complete binary trees: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""
    base: float
    feature: np.ndarray    # (trees, 2^depth - 1)
    threshold: np.ndarray  # (trees, 2^depth - 1); a row goes right if its value is greater
    leaf: np.ndarray       # (trees, 2^depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        z = self.base + self.leaf[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boosted trees of logistic loss on binned features."""
    n, inner = len(y), 2 ** depth - 1
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Forest(base if n == 0 or 0 < y.mean() < 1 else (3.0 if y[0] else -3.0), np.zeros((0, inner), np.int64),
                      np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    fs, ts, leaves = [], [], []
    z = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            node = at - first
            best = np.full(width, 1e-6)
            split_bin, split_f = np.full(width, bins), np.zeros(width, np.int64)
            for f in range(x.shape[1]):
                key = node * bins + binned[:, f]
                hist = [np.cumsum(np.bincount(key, w, width * bins).reshape(width, bins), axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = hist, (a[:, -1:] for a in hist)
                gain = gl ** 2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt ** 2 / (ht + SMOOTH)
                gain = np.where((nl >= LEAST) & (nt - nl >= LEAST), gain, 0)
                b = gain.argmax(axis=1)
                v = gain[np.arange(width), b]
                better = v > best
                best, split_bin, split_f = np.where(better, v, best), np.where(better, b, split_bin), np.where(better, f, split_f)
            for k in range(width):
                feature[first + k] = split_f[k]
                if split_bin[k] < len(cuts[split_f[k]]):
                    threshold[first + k] = cuts[split_f[k]][split_bin[k]]
            at = 2 * at + 1 + (binned[np.arange(n), split_f[node]] > split_bin[node])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + SMOOTH)
        z += value[leaf]
        fs.append(feature)
        ts.append(threshold)
        leaves.append(value)
    return Forest(base, np.stack(fs), np.stack(ts), np.stack(leaves))


# -------------------------------------------------------------------------------- DataFrames
def featurize(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            x = features(piece.column(1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([piece.column(0), flat], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, part: int = 1,
          max_docs: int = FIT_DOCS) -> Forest:
    ids = labelled_ids(labels, label, parts, part, max_docs)
    rows = featurize(docs.join(F.broadcast(ids), "doc_id", "left_semi")).join(F.broadcast(ids), "doc_id")
    got = rows.select("doc_id", "x", "label").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, got.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, forest: Forest, parts: int = 3, part: int = 1, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            s = model.value.score(features(piece.column(1)))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out("doc_id", parts, part).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
