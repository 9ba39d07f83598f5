"""Token ids in fixed-width bit-packed blocks.

Each id takes the minimum number of bits of the vocabulary. A block holds whole documents, at least
``BLOCK_IDS`` ids unless it is the last of a slice of text; its payload is read with vectorised numpy from any
position. Blocks are rows of Parquet files, so that any store that Spark reaches can hold them:

``part``       writing task; parts follow each other in document order
``part_start`` ids of this part before the block
``n_ids``      ids in the block
``width``      bits per id
``doc_ids``, ``lengths``  documents of the block in order and their number of ids
``payload``    the packed ids, little-endian bit order

The global position of a block is the offset of its part (:func:`part_offsets`, one row per writing
task) plus ``part_start``.

Defined results: documents are ordered by (doc_id, text), null ids first; repeated rows stay repeated; a
null or empty text has the end id alone; an empty table gives no blocks. Extra columns are ignored. A
document must fit a task's memory, as its text does.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import text_slices
from tillroll.llm.tokens import encoder

BLOCK_IDS = 65_536
BLOCK_SCHEMA = ("part int, part_start long, n_ids long, width int, doc_ids array<long>, lengths array<long>, "
                "payload binary")


_BLOCK = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
                    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def id_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """64 ids take ``width`` words of 64 bits; each of the 64 columns is shifted to its place in its word, and what a word
    cannot hold goes to the next."""
    rows = -(-len(ids) // 64)
    columns = np.zeros((rows, 64), np.uint64)
    columns.ravel()[:len(ids)] = ids
    words = np.zeros((rows, width + 1), np.uint64)
    for i in range(64):
        word, bit = divmod(i * width, 64)
        words[:, word] |= columns[:, i] << np.uint64(bit)
        if bit + width > 64:
            words[:, word + 1] |= columns[:, i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(words[:, :width], "<u8").view(np.uint8).ravel()[:(len(ids) * width + 7) // 8].tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a block; only their bytes are touched."""
    skip = start % 64
    rows = -(-(skip + count) // 64)
    raw = np.frombuffer(payload, np.uint8)[(start - skip) // 8 * width:(start - skip) // 8 * width + rows * width * 8]
    words = np.zeros((rows, width + 1), np.uint64)
    whole = np.zeros(rows * width * 8, np.uint8)
    whole[:len(raw)] = raw
    words[:, :width] = whole.view("<u8").reshape(rows, width)
    out = np.empty((rows, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, bit = divmod(i * width, 64)
        value = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - bit)
        out[:, i] = value & mask
    return out.ravel()[skip:skip + count]


def write_blocks(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int = 0,
                 block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text) in document order and write the blocks to ``path``."""
    width = id_width(vocabulary)
    mark = F.xxhash64("text")
    ordered = (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), mark)
               .sortWithinPartitions("doc_id", mark, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for piece in text_slices(batches):
            found, sizes = encode(piece.column(1).to_pylist())
            # the end id after each document
            found = np.insert(found, np.cumsum(sizes), end_id).astype(np.uint32)
            ends = np.cumsum(sizes + 1)
            first = 0
            while first < len(ends):
                begin = int(ends[first - 1]) if first else 0
                stop = min(int(np.searchsorted(ends, begin + block_ids)) + 1, len(ends))
                row = {"part": part, "part_start": done + begin, "n_ids": int(ends[stop - 1]) - begin, "width": width,
                       "doc_ids": piece.column(0).slice(first, stop - first).to_pylist(), "lengths": (sizes[first:stop] + 1).tolist(),
                       "payload": pack(found[begin:int(ends[stop - 1])], width)}
                yield pa.RecordBatch.from_pylist([row], _BLOCK)
                first = stop
            done += len(found)

    ordered.mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)


def part_offsets(blocks: DataFrame) -> DataFrame:
    """``part, part_offset``: ids of all parts before; one row per writing task."""
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``, from the blocks alone."""
    # One row per writing task, so the broadcast is bounded by the number of shuffle partitions.
    placed = blocks.join(F.broadcast(part_offsets(blocks)), "part").select(
        (F.col("part_offset") + F.col("part_start")).alias("start"), "width", "doc_ids", "lengths", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, width = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                sizes = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                begin = np.cumsum(sizes) - sizes
                ids = unpack(batch.column(4)[i].as_buffer(), width, 0, int(sizes.sum()))
                sums = [zlib.crc32(ids[b:b + n].tobytes()) for b, n in zip(begin, sizes)]
                yield pa.RecordBatch.from_arrays([batch.column(2)[i].values, pa.array(begin + at), pa.array(sizes, pa.int64()),
                                                  pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_size(tokenizer: str) -> int:
    return encoder(tokenizer).tokenizer.get_vocab_size()
