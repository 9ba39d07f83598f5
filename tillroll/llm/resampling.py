"""Importance resampling towards a target corpus: hashed runs of words, log ratios of their buckets, Gumbel draw.

**Dictionary.** The distinct words of a window of text become the keys of an Aho-Corasick automaton, each between two
delimiters, so that a key matches whole words alone. A key carries the payload (CRC-32, bytes) of its word. One scan of the
window emits the payload of each word in order. Windows end at delimiters, so no word is cut, and the memory of a task is
bounded by a window; a word of more than ``LONG_WORD`` bytes is known to the automaton by a stand-in of one character.

**Composition.** The checksum of a run of words follows from the payloads of its neighbours: appending ``n`` bytes shifts
a CRC by a linear map over GF(2), applied by table lookups for each bit of ``n``. No run is ever spelled out.

**Scoring.** Counts of ``buckets`` buckets (a parameter, so a bounded table) over the whole corpus and the whole target give
each bucket a gain; a document's weight is the floored mean of the gains of its features; a Gumbel noise drawn from its id
is added, and the documents of highest score are drawn without replacement.

The texts are scanned once: each document's buckets are stored packed, and counting and scoring read that table.

Defined results: a null or empty text has no features, weight 0 and no rank; a null id is drawn by the empty string; rows
equal in score and id are ranked by a hash of their text; repeated rows are separate documents with ranks of their own; an
empty table gives no rows, an empty target leaves every gain to the corpus. Extra columns are ignored. The text of one
document and its packed buckets must fit a task, as a text is one row.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from functools import cache
from operator import itemgetter
from typing import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import ranked, store, text_slices

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 2024, 20, 10
WINDOW_BYTES = 4 << 20
LONG_WORD = 256

# Bytes of words stay, A-Z become a-z, every other ASCII byte is the delimiter.
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_NORMAL = bytes(b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LONG = re.compile(rb"[^ ]{%d,}" % (LONG_WORD + 1))


def payloads(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and bytes of each word of normalised text (no word crosses its ends), by an automaton scan."""
    long_words = sorted(set(_LONG.findall(words)))
    names = {w: chr(256 + i) for i, w in enumerate(long_words)}
    if names:  # code points from 256 on name the long words, those below are the bytes of the others
        line = "".join(names[p] if p in names else p.decode("latin-1") for p in re.split(b"(%s)" % _LONG.pattern, words))
    else:
        line = words.decode("latin-1")
    distinct = [w for w in set(words.split()) if w not in names] + long_words
    if not distinct:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, w in enumerate(distinct):
        automaton.add_word(f" {names[w] if w in names else w.decode('latin-1')} ", i)
    automaton.make_automaton()
    found = np.fromiter(map(itemgetter(1), automaton.iter(f" {line} ")), np.int64)
    crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    return crc[found], size[found]


@cache
def _shifts() -> list[np.ndarray]:
    """For each bit of a byte count, the map that appends so many zero bytes to a CRC, as tables for its four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    basis = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    maps = [step[basis & 255] ^ (basis >> 8)]
    for _ in range(31):
        maps.append(_apply(maps[-1], maps[-1]))
    return maps


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def join_crc(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of left text + right text from both CRCs and the bytes of the right one."""
    out = left.copy()
    for bit in range(int(size.max(initial=0)).bit_length()):
        some = size >> bit & 1 == 1
        out[some] = _apply(_shifts()[bit], out[some])
    return out ^ right


def run_crcs(crc: np.ndarray, size: np.ndarray, shortest: int, longest: int) -> np.ndarray:
    """CRCs of all runs of ``shortest`` to ``longest`` words of one document, joined by one space."""
    blank = np.uint32(zlib.crc32(b" "))
    out, run = [], crc
    for n in range(1, min(longest, len(crc)) + 1):
        if n > 1:
            spaced = join_crc(run[:-1], np.full(len(run) - 1, blank), np.ones(len(run) - 1, np.int64))
            run = join_crc(spaced, crc[n - 1:], size[n - 1:])
        if n >= shortest:
            out.append(run)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _windows(text: bytes) -> Iterator[bytes]:
    """Normalised pieces of about ``WINDOW_BYTES`` that end at delimiters."""
    text, at = text.translate(_NORMAL), 0
    while at < len(text):
        cut = text.find(b" ", at + WINDOW_BYTES)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut


def text_features(texts: list[str | None], shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per text its number of words and the CRCs of its runs. All texts of the call share a dictionary per window."""
    raw = [(t or "").encode() for t in texts]
    joined = [payloads(w) for w in _windows(b"\n".join(raw))]
    crc = np.concatenate([c for c, _ in joined]) if joined else np.zeros(0, np.uint32)
    size = np.concatenate([s for _, s in joined]) if joined else np.zeros(0, np.int64)
    at = 0
    for t in raw:
        stop = at + len(t.translate(_NORMAL).split())
        yield stop - at, run_crcs(crc[at:stop], size[at:stop], shortest, longest)
        at = stop


def _bucket_type(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def bucket_rows(docs: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, mark, slot, n_words, buckets``: packed bucket of each feature; ``slot`` tells repeated rows apart."""
    kind = _bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for piece in text_slices(batches, limit=WINDOW_BYTES):
            found = list(text_features(piece.column(1).to_pylist(), shortest, longest))
            packed = [(crc % np.uint32(buckets)).astype(kind).tobytes() for _, crc in found]
            n = piece.num_rows
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(np.arange(seen, seen + n)),
                 pa.array([w for w, _ in found], pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "mark", "slot", "n_words", "buckets"])
            seen += n

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(run, "doc_id long, mark long, slot long, n_words long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket over all rows: one row per task and bucket, summed by Spark; ``buckets`` numbers reach the driver."""
    kind = _bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket, in doubles."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + b)) / float((s + 1) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_rows(rows: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    kind = _bucket_type(len(gain))
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_words = batch.column(0), batch.column(3)
            found = [np.frombuffer(p.as_buffer(), kind) for p in batch.column(4)]
            weight = [int(shared.value[f].sum()) // len(f) if len(f) else 0 for f in found]
            score = [w + noise(i, seed) for w, i in zip(weight, ids.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1), batch.column(2), n_words, pa.array(map(len, found), pa.int64()),
                 pa.array(weight, pa.int64()), pa.array(score, pa.int64())],
                names=["doc_id", "mark", "slot", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, "doc_id long, mark long, slot long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS,
             seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document of ``docs`` (doc_id, text); ``target`` has a text."""
    rows = store(bucket_rows(docs, shortest, longest, buckets), "word-buckets")
    wanted = bucket_rows(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), shortest, longest, buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    scored = store(score_rows(rows, gain, seed), "importance-scores")
    able = scored.where(F.col("n_words") >= min_words)
    draw = able.count() * percent // 100
    placed = ranked(able, [F.desc("score"), F.asc("doc_id"), F.asc("mark"), F.asc("slot")], "importance-order")
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return (placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(rest)
            .select("doc_id", "n_features", "weight", "score", "rank"))


# The checksum of a word byte by byte, from a table made by its rule; each distinct word once.
ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
doc AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM doc),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
vocab AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
hashed AS (SELECT word, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM vocab, crc_table),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT b.bucket, CAST(floor(1000 * ln(
    CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM dw) + 10000) AS DOUBLE)
    / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bw) + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT r, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
                                 + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weighed USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM placed
"""
