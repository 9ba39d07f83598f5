"""Benchmark decontamination with a distributed positional inverted index.

1. The benchmark items become windows of ``WINDOW`` consecutive words. A block of at most
   ``BLOCK_WORDS`` item words gives a bounded vocabulary, which is broadcast; larger benchmarks are
   searched in several blocks.
2. The corpus is tokenised once per block, and the postings of vocabulary terms (term, positions) are
   stored in the shared folder beside their document, so a document's lists are intersected without a
   shuffle and a frequent term fills no task.
3. Document frequencies of the terms are counted from the stored index, and every window's terms are put
   in the order of rising frequency.
4. Each document starts from the windows whose rarest term it has; that term's positions less the
   term's offset are the candidate starts, which are intersected with the next rarer term's positions
   less its offset, and so on. What is left after the last term are exact phrase matches. Windows whose
   ``PROXIMITY_TERMS`` rarest terms lie within ``PROXIMITY_SPAN`` words are proximity matches.

Words: runs of ``[0-9a-z]`` and non-ASCII characters after A-Z is lower-cased. An item with fewer words
than a window, but not none, is one window.

Defined results: null and empty texts have no words and no hits; items without words are never found;
items with equal texts are found together; repeated rows get equal results; empty tables give no rows or no
hits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import store, text_slices

WINDOW = 10
BLOCK_WORDS = 2_000_000
PROXIMITY_TERMS, PROXIMITY_SPAN = 4, 20

_KEEP = {*range(48, 58), *range(97, 123), *range(128, 256)}
_SPELL = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPELL).split()


def row_key(doc_id: int | None, text: str | None) -> bytes:
    return hashlib.blake2b(f"{doc_id}\0{text or ''}".encode(), digest_size=16).digest()


@dataclass
class Queries:
    """Windows of a block of items; terms are numbers in ``vocabulary``."""
    vocabulary: dict[bytes, int]
    windows: list[tuple[int, ...]]
    items: list[list]              # item ids of each window

    @staticmethod
    def build(items: list[tuple], size: int = WINDOW) -> "Queries":
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                found[tuple(ids[i:i + size])].add(item)
        return Queries(vocabulary, list(found), [sorted(v) for v in found.values()])


class Search:
    """Windows by their rarest term, with the (term, offset) pairs in the order of rising frequency."""

    def __init__(self, queries: Queries, frequency: dict[int, int]):
        self.size = [len(w) for w in queries.windows]
        self.items = queries.items
        self.plan = [sorted(((t, k) for k, t in enumerate(w)), key=lambda x: (frequency.get(x[0], 0), x)) for w in queries.windows]
        self.first: dict[int, list[int]] = defaultdict(list)
        for w, plan in enumerate(self.plan):
            self.first[plan[0][0]].append(w)

    def phrases(self, postings: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
        """(window, starts) of all exact matches in one document."""
        out = []
        for term in postings.keys() & self.first.keys():
            for w in self.first[term]:
                plan = self.plan[w]
                if any(t not in postings for t, _ in plan):
                    continue
                starts = postings[term] - plan[0][1]
                for t, k in plan[1:]:
                    have = postings[t]
                    at = np.searchsorted(have, starts + k)
                    starts = starts[(at < len(have)) & (have[np.minimum(at, len(have) - 1)] == starts + k)]
                    if not len(starts):
                        break
                if len(starts):
                    out.append((w, starts))
        return out

    def near(self, postings: dict[int, np.ndarray]) -> list[int]:
        """Windows whose rarest terms stand within :data:`PROXIMITY_SPAN` words, in any order."""
        out = []
        for term in postings.keys() & self.first.keys():
            for w in self.first[term]:
                rare = list(dict.fromkeys(t for t, _ in self.plan[w]))[:PROXIMITY_TERMS]
                if any(t not in postings for t in rare):
                    continue
                # a stretch may begin at any of the terms' positions
                begin = np.unique(np.concatenate([postings[t] for t in rare]))
                fits = np.ones(len(begin), bool)
                for t in rare:
                    have = postings[t]
                    at = np.searchsorted(have, begin)
                    fits &= (at < len(have)) & (have[np.minimum(at, len(have) - 1)] < begin + PROXIMITY_SPAN)
                if fits.any():
                    out.append(w)
        return out


# -------------------------------------------------------------------------------------- index
INDEX = "doc_id long, key binary, n_words long, terms array<int>, counts array<int>, positions array<int>"


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Stored postings of ``vocabulary`` for every row of ``docs``; ``key`` is the hash of id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for piece in text_slices(batches):
            ids, keys, sizes, doc, term, place = [], [], [], [], [], []
            for i, (d, text) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())):
                ws = words(text)
                codes = np.array([known.get(w, -1) for w in ws], np.int32)
                at = np.flatnonzero(codes >= 0).astype(np.int32)
                order = np.argsort(codes[at], kind="stable")
                term.append(codes[at][order])
                place.append(at[order])
                ids.append(d)
                sizes.append(len(ws))
                keys.append(row_key(d, text))
                doc.append(len(at))
            flat = np.concatenate(term)
            row = np.repeat(np.arange(len(ids)), doc)
            new = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])) if len(flat) else np.zeros(0, int)
            per_term = np.diff(np.concatenate([new, [len(flat)]])).astype(np.int32)
            t_off = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(ids)))]).astype(np.int32)
            p_off = np.concatenate([[0], np.cumsum(doc)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(o), pa.array(v)) for o, v in
                     ((t_off, flat[new]), (t_off, per_term), (p_off, np.concatenate(place)))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *lists],
                                             names=["doc_id", "key", "n_words", "terms", "counts", "positions"])

    return store(docs.select("doc_id", "text").mapInArrow(run, INDEX), "postings")


def frequencies(index: DataFrame) -> dict[int, int]:
    """Documents per term; as many rows as the block's vocabulary at most."""
    rows = index.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


HITS = "key binary, items array<string>, near_items array<string>, spans array<struct<start:int,end:int>>"


def search_index(index: DataFrame, queries: Queries) -> DataFrame:
    """For each row with a match: its key, the ids of found items and the word spans of the matches."""
    shared = index.sparkSession.sparkContext.broadcast(Search(queries, frequencies(index)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                terms = batch.column(1)[i].values.to_numpy()
                if not any(t in search.first for t in terms.tolist()):
                    continue
                cut = np.cumsum(batch.column(2)[i].values.to_numpy())[:-1]
                postings = dict(zip(terms.tolist(), np.split(batch.column(3)[i].values.to_numpy(), cut)))
                exact, near = search.phrases(postings), search.near(postings)
                if exact or near:
                    rows.append({"key": batch.column(0)[i].as_py(),
                                 "items": sorted({str(x) for w, _ in exact for x in search.items[w]}),
                                 "near_items": sorted({str(x) for w in near for x in search.items[w]}),
                                 "spans": sorted({(int(s), int(s) + search.size[w]) for w, starts in exact for s in starts})})
            if rows:
                span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                yield pa.RecordBatch.from_pylist(
                    [r | {"spans": [{"start": a, "end": b} for a, b in r["spans"]]} for r in rows],
                    pa.schema([("key", pa.binary()), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string())),
                               ("spans", pa.list_(span))]))

    return index.select("key", "terms", "counts", "positions").mapInArrow(run, HITS)


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """Items in runs of at most ``block_words`` words (one item at least), read one run at a time."""
    held: list[tuple] = []
    size = 0
    for item, text in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        n = len(words(text))
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += n
    yield held


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, key, n_words, items, near_items, spans`` per row of ``docs`` (lists empty without a match)."""
    base, hits = None, []
    for block in blocks(items, block_words):
        queries = Queries.build(block, window)
        index = build_index(docs, queries.vocabulary)
        base = index.select("doc_id", "key", "n_words") if base is None else base
        hits.append(search_index(index, queries))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    merged = found.groupBy("key").agg(union("items"), union("near_items"), union("spans"))
    out = base.join(merged, "key", "left")
    none = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("items", "near_items", "spans")}
    return out.select("doc_id", "key", "n_words", *[v.alias(c) for c, v in none.items()])


def covered(spans: str) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"),
                                 F.greatest(a["upto"], s["end"]).alias("upto"))
    return F.aggregate(spans, start, step, lambda a: a["n"]).cast("long")


def report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"))
