"""Removal of long repeated byte strings, exactly and across all documents, by suffix arrays of content-dealt shards.

A string of ``LENGTH`` bytes that starts at two places is found where suffixes share ``LENGTH`` bytes. Suffixes are dealt to
shards by content, so that no shard depends on where a text is stored:

1. *Texts.* Equal texts become one row with a mark (all of a repeated text goes). The table is bucketed by a hash of the text,
   so that the later joins with it move no text.
2. *Anchors.* The least hash of the ``GRAM``-byte strings inside a window of ``LENGTH`` bytes depends on the window alone.
   Neighbouring windows with one anchor form a segment. Equal windows have equal anchors, so anchors that occur once in the
   corpus (a sum per anchor, combined before the shuffle) are settled, and so are those around which all segments are equal.
3. *Shards.* One of each group of equal segments around every other anchor is cut from its text; the segments of an anchor are
   a shard. Shards are sorted by induction, many at a time (``induced_sort``), and neighbours in a suffix array with a common
   prefix of ``LENGTH`` bytes are repeats. A shard of more than ``SHARD_SEGMENTS`` segments (a passage inside very many
   texts) is split again by content: windows with the anchor at about the same place share a longer string than the anchor,
   and equal windows share all of it. Equal parts collapse before they are shuffled on, so no group is held by a task.
4. *Spans.* Repeated windows go back to the places of their segments, their union is cut from each text.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing; equal texts of at least ``LENGTH`` bytes lose
everything, a repeated row included; overlapping repeats inside one text count; an empty table gives no rows. Extra columns are
ignored. A text and the marks of its anchors must fit a task, as a text is one row; windows of a long text are hashed in
chunks. Texts are told apart by 128 bits, segments by 64 bits beside the 64 of their anchor.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import cache, reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import shared_path, store, text_bytes, text_slices
from tillroll.llm.induced_sort import common_prefixes, suffix_arrays
from tillroll.session import shuffle_partitions

LENGTH, GRAM = 200, 32
CHUNK = 1 << 18            # bytes whose windows are hashed in one step
SHARD_SEGMENTS = 64        # a larger shard is split
PARTS = 4                  # segments that a segment of such a shard is split into, at most
BATCH_BYTES = 2 << 20      # shards of about one size that are sorted together
SEEN_TEXTS = 1 << 18       # hashes of texts that a task remembers

_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    for shift in (32, 29):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@cache
def _powers(n: int, inverse: bool, which: int) -> np.ndarray:
    base = _BASE[which]
    out = np.full(n, pow(base, -1, 1 << 64) if inverse else base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hashes of any substrings of ``raw`` from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        n = 1 << max(10, int(len(raw)).bit_length())
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * _powers(n, False, which)[:len(raw)], out=self.sums[1:])
        self.back = _powers(n, True, which)

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[:len(self.sums)][start]


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the (first) least of each ``width`` neighbours; ties are decided by the upper 40 bits' order."""
    n = len(hashes) - width + 1
    low = np.uint64((1 << 24) - 1)
    key = np.full(-(-len(hashes) // width) * width + width, np.iinfo(np.uint64).max)
    key[:len(hashes)] = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & low).astype(np.int64)


def segments(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of texts that lie one after the other in ``raw``: index of the text, first and last window (positions in
    ``raw``), anchor position, hash of the anchor, hash of the segment."""
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    hashes = Hashes(raw)
    grams = mix(hashes.of(slice(0, len(raw) - gram + 1), slice(gram, len(raw) + 1)))
    anchor = _least(grams, length - gram + 1)
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    begins = np.concatenate([[0], ends[:-1]])
    edges = np.concatenate([begins, np.maximum(ends - length + 1, begins)])
    fresh[edges[edges < len(anchor)]] = True
    first = np.flatnonzero(fresh)
    final = np.append(first[1:], len(anchor)) - 1
    text = np.searchsorted(ends, first, side="right")
    inside = first + length <= ends[text]
    first, final, text = first[inside], final[inside], text[inside]
    at = anchor[first]
    content = mix(hashes.of(first, final + length) + mix((at - first + 1).astype(np.uint64)))
    return text, first, final, at, grams[at], content


def _chunks(raw: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Runs of whole texts of about ``CHUNK`` bytes, and chunks of longer ones that share ``length - 1`` bytes: bytes, ends of
    their texts, first text, position of the bytes in the first text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1, i + 1)
        size = int(off[j] - off[i])
        if size <= CHUNK:
            yield raw[off[i]:off[j]], off[i + 1:j + 1] - off[i], i, 0
        else:
            for at in range(0, max(size - length + 1, 1), CHUNK):
                stop = min(at + CHUNK + length - 1, size)
                yield raw[off[i] + at:off[i] + stop], np.array([stop - at]), i, at
        i = j


def _places(texts: pa.Array, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk: row of the text, first window (position in the text), windows, anchor hash, segment hash."""
    raw, off = text_bytes(texts)
    for piece, ends, row, shift in _chunks(raw, off, length):
        text, first, final, _, g, s = segments(piece, ends, length, gram)
        begin = np.concatenate([[0], ends[:-1]])[text]
        yield text + row, first - begin + shift, final - first + 1, g.view(np.int64), s.view(np.int64)


def _record(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _text(column: str = "text") -> Column:
    return F.coalesce(column, F.lit(""))


def _keys() -> list[Column]:
    return [F.xxhash64(_text()).alias("k1"), F.xxhash64(F.lit(1), _text()).alias("k2")]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``k1, k2, text, twice`` bucketed by the text's hash: each text once, ``twice`` if more than one row has it."""
    spark = docs.sparkSession

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task sends a text once, and a second time without its bytes.
        seen: dict = {}
        for piece in text_slices(batches):
            keys = list(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()))
            send, bare = [], []
            for i, k in enumerate(keys):
                times = seen.get(k, 0)
                if times < 2:
                    send.append(i)
                    bare.append(times == 1)
                    seen[k] = times + 1
            if len(seen) > SEEN_TEXTS:
                seen = {}
            part = piece.take(pa.array(send, pa.int64()))
            empty = pa.array([None if b else True for b in bare], pa.bool_())
            texts = pa.compute.if_else(pa.compute.is_valid(empty), part.column(2), pa.scalar(None, part.column(2).type))
            yield _record("k1 k2 text", part.column(0), part.column(1), texts)

    def join_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, text, copies = None, "", 0
        for piece in text_slices(batches):
            out: list = []
            for k1, k2, t in zip(*(piece.column(i).to_pylist() for i in range(3))):
                if (k1, k2) != held:
                    if held:
                        out.append((*held, text, copies > 1))
                    held, text, copies = (k1, k2), t, 0
                copies += 1
            yield _texts(out)
        if held:
            yield _texts([(*held, text, copies > 1)])

    def _texts(rows: list) -> pa.RecordBatch:
        k1, k2, text, twice = zip(*rows) if rows else ((),) * 4
        return _record("k1 k2 text twice", pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(text, pa.string()), pa.array(twice, pa.bool_()))

    parts = shuffle_partitions(spark)
    sent = docs.select(*_keys(), _text().alias("text")).mapInArrow(once, "k1 long, k2 long, text string")
    merged = (sent.repartition(parts, "k1").sortWithinPartitions("k1", "k2", F.col("text").isNull())
              .mapInArrow(join_equal, "k1 long, k2 long, text string, twice boolean"))
    name = f"texts_{uuid.uuid4().hex}"
    (merged.write.format("parquet").option("compression", "zstd").option("path", shared_path(spark, "texts"))
     .bucketBy(parts, "k1").saveAsTable(name))
    texts = spark.table(name)
    # The table's files stay in the shared folder; only its name leaves the session's catalogue.
    spark.sql(f"DROP TABLE {name}")
    return texts


def anchor_places(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``g, s, k1, k2, twice, first, windows`` of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            k1, k2, twice = (piece.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            for row, first, windows, g, s in _places(piece.column(2), length, gram):
                yield _record("g s k1 k2 twice first windows", g, s, k1[row], k2[row], twice[row], first, windows.astype(np.int16))

    return texts.select("k1", "k2", "text", "twice").mapInArrow(
        run, "g long, s long, k1 long, k2 long, twice boolean, first long, windows short")


def repeated_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``g, alike`` of the anchors that occur more than once; ``alike``: all segments around it are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            twice = piece.column(1).to_numpy(zero_copy_only=False)
            for row, _, _, g, s in _places(piece.column(0), length, gram):
                yield _record("g s n", g, s, 1 + twice[row].astype(np.int64))

    found = texts.select("text", "twice").mapInArrow(run, "g long, s long, n long")
    return (found.groupBy("g").agg(F.sum("n").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
            .where("n > 1").select("g", (F.col("low") == F.col("high")).alias("alike")))


def cut_segments(texts: DataFrame, chosen: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, g, s, copies, base, low, high, bytes`` of the chosen segments (one place of each), from the bucketed texts:
    ``bytes`` holds the windows from number ``base`` of segment (g, s) on, ``low`` to ``high`` the string that all windows
    of the shard ``key`` share (here the anchor)."""
    wanted = chosen.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
        F.collect_list(F.struct("g", "s", "copies", F.col("at.first").alias("first"), F.col("at.windows").alias("windows"))).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            raw, off = text_bytes(piece.column(0))
            cuts = piece.column(1)
            flat = cuts.flatten()
            row = np.repeat(np.arange(len(cuts)), cuts.value_lengths().to_numpy(zero_copy_only=False))
            g, s, copies, first, windows = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            start = off[row] + first
            size = windows.astype(np.int64) + length - 1
            for a in range(0, len(row), 4096):
                b = min(a + 4096, len(row))
                parts = _slices(raw, start[a:b], size[a:b])
                _, first_window, _, at, _, _ = segments(*_joined_bytes(parts), length, gram)
                low = at - first_window
                yield _record("key g s copies base low high bytes", g[a:b], g[a:b], s[a:b], copies[a:b], np.zeros(b - a, np.int64),
                              low, low + gram, parts)

    return texts.join(wanted, ["k1", "k2"]).select("text", "cuts").mapInArrow(
        run, "key long, g long, s long, copies long, base long, low long, high long, bytes binary")


def _joined_bytes(parts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    raw, off = text_bytes(parts)
    return raw, off[1:]


def repeated_windows(shards: list[list[tuple[bytes, int]]], length: int) -> list[list[np.ndarray]]:
    """Per shard and segment (bytes, copies) its repeated windows as flags, by suffix arrays of all shards at once."""
    # 0 ends a shard, 1 ends a segment, bytes are 2 and more.
    lines = [b"".join(seg + b"\0" for seg, _ in shard) for shard in shards]
    flat = np.frombuffer(b"\0".join(lines) + b"\0", np.uint8).astype(np.int64) + 2
    size = np.array([len(x) + 1 for x in lines])
    start = np.cumsum(size) - size
    seg_size = np.array([len(seg) for shard in shards for seg, _ in shard])
    copies = np.array([n for shard in shards for _, n in shard])
    shard_of = np.repeat(np.arange(len(shards)), [len(s) for s in shards])
    # Every segment before it adds its separator, every shard before it its end.
    begin = np.cumsum(seg_size + 1) - (seg_size + 1) + shard_of
    flat[begin + seg_size] = 1
    flat[start + size - 1] = 0
    sa = suffix_arrays(flat, start, size, np.full(len(size), 258))
    prefix = common_prefixes(flat, sa, start, 1)
    repeat = prefix >= length
    hit = repeat.copy()
    # A suffix repeats if it shares enough with the suffix before or after it.
    hit[sa[np.flatnonzero(repeat[sa]) - 1]] = True
    out = [hit[b:b + n - length + 1] | (c > 1) for b, n, c in zip(begin.tolist(), seg_size.tolist(), copies.tolist())]
    ends = np.cumsum([len(s) for s in shards]).tolist()
    return [out[a:b] for a, b in zip([0, *ends], ends)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def sort_shards(cuts: DataFrame, length: int) -> DataFrame:
    """``g, s, begin, end``: runs of repeated windows of shards that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[int, list] = {}

        def found(batch: list) -> pa.RecordBatch:
            rows = ([], [], [], [])
            for shard, flags in zip(batch, repeated_windows([[(b, n) for _, _, n, _, b in shard] for shard in batch], length)):
                for (g, s, _, base, _), flag in zip(shard, flags):
                    begins, ends = _runs(flag)
                    for out, value in zip(rows, ([g] * len(begins), [s] * len(begins), begins + base, ends + base)):
                        out.extend(value)
            return _record("g s begin end", *(pa.array(r, pa.int64()) for r in rows))

        for shard in _shards(batches):
            size = sum(len(row[-1]) for row in shard)
            batch = classes.setdefault(size.bit_length(), [])
            batch.append(shard)
            if len(batch) * size > BATCH_BYTES:
                yield found(classes.pop(size.bit_length()))
        for batch in classes.values():
            yield found(batch)

    return (cuts.select("key", "g", "s", "copies", "base", "bytes").repartition("key").sortWithinPartitions("key")
            .mapInArrow(run, "g long, s long, begin long, end long"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    held, shard = None, []
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if key != held and shard:
                yield shard
                shard = []
            held = key
            shard.append(row)
    if shard:
        yield shard


def split(cuts: DataFrame, length: int, gram: int) -> DataFrame:
    """Every segment of ``cuts`` as up to ``PARTS`` shorter ones, by the place of the common string (the anchor at first)
    in the window. Windows of one part share a longer common string, which is the key of the new shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                piece = batch.slice(a, 4096)
                key, g, s, copies, base, low, high = (piece.column(i).to_numpy() for i in range(7))
                raw, off = text_bytes(piece.column(7))
                size = np.diff(off)
                span = length - (high - low)  # the common string starts 0 to span bytes after the window
                part = np.tile(np.arange(PARTS), len(key))
                row = np.repeat(np.arange(len(key)), PARTS)
                least, most = (span[row] + 1) * part // PARTS, (span[row] + 1) * (part + 1) // PARTS
                first = np.maximum(low[row] - most + 1, 0)
                last = np.minimum(low[row] - least, size[row] - length)
                some = (least < most) & (first <= last)
                row, part, least, most, first, last = (x[some] for x in (row, part, least, most, first, last))
                new_low, new_high = low[row] - least, low[row] - most + 1 + length
                hashes = Hashes(raw, 1)
                start = off[row]
                common = mix(hashes.of(start + new_low, start + new_high) + mix(key[row].view(np.uint64) + part.astype(np.uint64) + np.uint64(1)))
                content = mix(hashes.of(start + first, start + last + length) + mix((new_low - first + 1).astype(np.uint64)))
                yield _record("key content g s copies base low high bytes", common.view(np.int64), content.view(np.int64), g[row], s[row],
                              copies[row], base[row] + first, new_low - first, new_high - first,
                              _slices(raw, start + first, last - first + length))

    return cuts.select("key", "g", "s", "copies", "base", "low", "high", "bytes").mapInArrow(
        run, "key long, content long, g long, s long, copies long, base long, low long, high long, bytes binary")


def _slices(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.BinaryArray:
    ends = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def large_shards(cuts: DataFrame) -> DataFrame:
    """Keys of shards of more than ``SHARD_SEGMENTS`` segments."""
    return store(cuts.groupBy("key").count().where(F.col("count") > SHARD_SEGMENTS).select("key", F.lit(True).alias("large")), "large-shards")


def repeats(cuts: DataFrame, length: int, gram: int) -> DataFrame:
    """``g, s, begin, end``: runs of repeated windows of all segments. Shards of up to ``SHARD_SEGMENTS`` segments are sorted,
    larger ones are split until none is left; at the latest a shard's common string is the whole window. Of equal segments of a
    split shard one goes on, and all their windows are repeats."""
    found = []
    while True:
        large = large_shards(cuts)
        if large.isEmpty():
            found.append(sort_shards(cuts, length))
            break
        dealt = cuts.join(large, "key", "left")
        found.append(sort_shards(dealt.where("large IS NULL"), length))
        parts = store(split(dealt.where("large"), length, gram), "split-segments")
        alike = store(parts.groupBy("key", "content").agg(F.sum("copies").alias("n"), F.min(F.struct("g", "s", "base")).alias("one")), "split-kinds")
        kinds = store(alike.groupBy("key").count().where("count > 1").select("key"), "split-shards")
        told = parts.join(alike, ["key", "content"])
        found.append(told.where("n > 1").select("g", "s", F.col("base").alias("begin"),
                                                (F.col("base") + F.length("bytes") - length + 1).alias("end")))
        cuts = store(told.where(F.col("one") == F.struct("g", "s", "base")).join(kinds, "key", "left_semi")
                     .select("key", "g", "s", F.col("n").alias("copies"), "base", "low", "high", "bytes"), "split-next")
    return reduce(DataFrame.unionByName, found)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (removed runs of bytes,
    ends excluded)."""
    texts = distinct_texts(docs)
    repeated = store(repeated_anchors(texts, length, gram), "repeated-anchors")
    # A repeated text goes as a whole; it stays only to be compared with others.
    marks = store(anchor_places(texts, length, gram).join(repeated, "g").where("NOT (alike AND twice)"), "repeat-places")
    unlike = marks.where("NOT alike")
    one = unlike.groupBy("g", "s").agg(F.sum(F.lit(1) + F.col("twice").cast("long")).alias("copies"),
                                       F.min(F.struct("k1", "k2", "first", "windows")).alias("at"))
    shards = store(one, "segments")
    cuts = store(cut_segments(texts, shards, length, gram), "segment-bytes")
    found = repeats(cuts, length, gram)
    # A repeated text needs no spans.
    place = unlike.where("NOT twice").select("g", "s", "k1", "k2", "first")
    spans = (place.join(found, ["g", "s"]).select("k1", "k2", (F.col("first") + F.col("begin")).alias("begin"),
                                                  (F.col("first") + F.col("end") - 1 + length).alias("end"))
             .unionByName(marks.where("alike").select(
                 "k1", "k2", F.col("first").alias("begin"), (F.col("first") + F.col("windows") - 1 + length).alias("end"))))
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            raw, off = text_bytes(piece.column(2))
            out = []
            for i, (twice, listed) in enumerate(zip(piece.column(3).to_pylist(), piece.column(4))):
                data = raw[off[i]:off[i + 1]]
                if twice and len(data) >= length:
                    begins, ends = np.array([0]), np.array([len(data)])
                else:
                    begins, ends = _union(listed)
                gone = np.zeros(len(data) + 1, np.int8)
                gone[begins] += 1
                gone[ends] -= 1
                kept = data[np.cumsum(gone[:-1], dtype=np.int8) == 0]
                out.append((len(data), int((ends - begins).sum()), len(begins), hashlib.sha256(kept).hexdigest(),
                            [{"begin": b, "end": e} for b, e in zip(begins.tolist(), ends.tolist())]))
            n, gone, count, digest, runs = zip(*out)
            yield _record("k1 k2 n_bytes n_removed n_spans kept_sha256 spans", piece.column(0), piece.column(1),
                          pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digest),
                          pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))

    done = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", "twice", "spans").mapInArrow(
        cut, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>")
    return docs.select("doc_id", *_keys()).join(done, ["k1", "k2"]).drop("k1", "k2")


def _union(listed: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the spans of one text; touching spans are one run."""
    if not listed.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = (listed.values.field(i).to_numpy() for i in range(2))
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate([[True], begin[1:] > reach[:-1]])
    return begin[fresh], np.append(reach[np.flatnonzero(fresh)[1:] - 1], reach[-1])
