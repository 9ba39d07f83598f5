"""Near-duplicate classes by an exact Jaccard join of word shingles in a metric space.

Jaccard distance is a metric, but documents without a common shingle are all at distance 1 from each
other and from any pivot document, so cells around pivot documents cannot split a corpus: every far
document would have to be copied into every cell. The join therefore has two levels of cells.

*Outer cells.* The pivots are small sets of shingles. Shingles are dealt by their hash into parts; two
sets that are linked differ in at most ``H`` shingles (a bound from their size class), so of more than ``H``
parts at least one is the same in both, and so is one of the first ``H + 1`` parts of each, in an order of parts
that all sets have in common. A document goes to the cells of these, parts with many shingles first. This puts
any linked pair into a common cell and almost nothing else; a passage that many documents share fills no
cell, as whole parts must be equal. A document takes part in its own size class and the next, as boundary
documents of a window do.

*Inner cells.* In each outer cell the first set is the pivot and its exact distance to every member is
taken. Members are then dealt into shells by that distance; by the triangle inequality two members can
only be linked if their distances to the pivot differ by at most the threshold, so a shell is joined with
members in that window alone. Each shell takes new pivots, more in each round, until every pair of members
is either tested, ruled out by its window or sketch, or already in one component. Every link that joins two
components is found, without all pairs of a group being formed.

*Sketches.* A set's sketch holds the parity of its shingles in each of 1,024 places. Two sketches differ in at
most as many bits as the sets differ in shingles, so a pair whose sketches differ in more bits than a link
allows is ruled out for certain, inside the join, before any text moves. Only what is left is tested on whole sets, made again from the texts, which
move in blocks.

Sets are compared by 64-bit shingle hashes, and equal sets share a 64-bit node number.

Defined results: a document's set has its distinct ``size``-word shingles, with fewer words the whole
sequence as one; without words it is empty and linked with nothing. Rows with a null id are not linked and
have a null class. Repeated rows are in one class; rows that share an id but not a text are separate
members. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import store, text_slices

SHINGLE, PERCENT = 4, 85
PIVOTS = 64  # pivots that a shell takes in the first round
MORE = 4  # times as many in each further one, so that the rounds grow with the logarithm of a shell
LEADS, FOLLOWERS = 512, 16_384  # sets of a block that are held at once, and those that stream by
SLOTS = 1 << 25  # bits that tell which texts are needed, 4 MB in all
SKETCH = [f"s{i}" for i in range(16)]  # a sketch as columns of 64 bits

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [(t or "").encode().translate(_LOWER).split() for t in texts]
    known: dict[bytes, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for ws in words for w in ws], np.int64)
    code = np.array([xxhash.xxh3_64_intdigest(w) for w in known] or [0], np.uint64)[flat] if len(flat) else np.zeros(0, np.uint64)
    out, at = [], 0
    for ws in words:
        h = code[at:at + len(ws)]
        at += len(ws)
        n = min(size, len(h))
        s = np.full(len(h) - n + 1 if n else 0, np.uint64(n))
        for k in range(n):
            s = s * _ODD + h[k:len(h) - n + 1 + k]
        out.append(np.unique(mix(s)))
    return out


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles in each place, as 64-bit numbers."""
    odd = np.bincount((mix(s + _ODD) % np.uint64(64 * len(SKETCH))).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@lru_cache(None)
def size_class(n: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """Number, least and largest size of the class of ``n``. The sizes of a linked pair are in one class
    or in neighbouring ones."""
    k, low = 0, 1
    while True:
        high = max(low + 1, -(-low * 100 // percent))
        if n < high:
            return k, low, high - 1
        k, low = k + 1, high


def most_differ(n: int, m: int, percent: int) -> int:
    """Most shingles in which linked sets of ``n`` and at most ``m`` shingles differ."""
    return (n + m) * (100 - percent) // (100 + percent)


@lru_cache(None)
def part_count(least: int, largest: int, percent: int) -> int:
    """Number of parts of a level with sets of ``least`` to ``largest`` shingles: a tenth more than the largest may differ in, and so
    many that even small sets nearly always fill more parts than they may differ in."""
    most = most_differ(largest, largest, percent)
    parts = most + 2 + most // 10
    for n in (least, largest):
        differ = most_differ(n, min(largest, n * 100 // percent), percent)
        while parts < 2 * most + 8:
            empty = parts * math.exp(-n / parts)
            if parts - differ > empty + 3 * math.sqrt(empty):
                break
            parts += 1
    return parts


def cells(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Numbers of the outer cells of a set. At the level of its size class it meets the sets of the class below, at the next level
    those of its own class and the one above. Linked sets that differ in ``d`` shingles differ in at most ``d`` parts, so in an
    order of all parts that is the same for every set, their first ``d + 1`` parts have one in common (the prefix
    principle). The order has parts with many shingles first: a part with one is shared by chance far more often."""
    n = len(s)
    k, low, top = size_class(n, percent)
    above = size_class(top + 1, percent)[2]
    out = []
    for level, least, partner, largest in ((k, size_class(max(low - 1, 1), percent)[1], low - 1, top), (k + 1, low, min(n * 100 // percent, above), above)):
        differ = most_differ(n, partner, percent)
        if not differ or 100 * partner < percent * n:
            continue  # sets of these sizes are linked only if they are equal, or not at all
        parts = part_count(least, largest, percent)
        part = (mix(s + np.uint64(level)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        p = part[order]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        filled, body = np.zeros(parts, np.int64), np.zeros(parts, np.uint64)
        filled[p[first]] = np.diff(np.append(first, n))
        body[p[first]] = np.add.reduceat(mix(s ^ _ODD)[order], first)
        number = mix(body + mix(np.arange(parts, dtype=np.uint64) * _ODD + np.uint64(level)))
        out.append(number[np.lexsort((number, -filled))[:differ + 1]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# -------------------------------------------------------------------------------- DataFrames
def sizes(docs: DataFrame, size: int, *extra: str) -> DataFrame:
    """Stored ``doc_id, n_shingles, node`` of every row (node null for empty sets) and its ``extra`` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            sets = shingle_sets(piece.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), *piece.columns[2:]],
                names=["doc_id", "n_shingles", "node", *extra])

    rows = docs.select("doc_id", "text", *extra)
    schema = ["doc_id long, n_shingles long, node long"] + [f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra]
    return store(rows.mapInArrow(run, ", ".join(schema)), "set-sizes")


def shared_cells(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored members of outer cells with at least two sets: ``cell, pivot, node`` (pivot: the smallest
    node of the cell, which has no row of its own)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            found, nodes, seen = [], [], set()
            for s in shingle_sets(piece.column(0).to_pylist(), size):
                node = node_of(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    c = cells(s, percent)
                    found.append(c)
                    nodes.append(np.full(len(c), node, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes))],
                                                 names=["cell", "node"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in the order (cell, node); a cell of any size passes as a stream.
        last_cell, last_node, pivot = None, None, 0
        for batch in batches:
            cell, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(cell):
                continue
            new = np.concatenate([[last_cell is None or cell[0] != last_cell], cell[1:] != cell[:-1]])
            again = ~new & (node == np.concatenate([[last_node or 0], node[:-1]]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(cell)), -1))
            pivots = np.where(start >= 0, node[start], pivot)
            keep = ~new & ~again
            last_cell, last_node, pivot = cell[-1], node[-1], pivots[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(pivots[keep]), pa.array(node[keep])],
                                                 names=["cell", "pivot", "node"])

    rows = docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(emit, "cell long, node long")
    ordered = rows.repartition("cell").sortWithinPartitions("cell", "node")
    return store(ordered.mapInArrow(members, "cell long, pivot long, node long"), "shared-cells")


def split(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in ``wanted``, and those whose key is not, by bitmaps of hash slots (at most ``SLOTS`` bits,
    broadcast). The first has a share of the others that grows with the number of wanted keys."""
    def placed(df: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)) + 1
        return df.withColumn("_map", F.bitmap_bucket_number(slot)).withColumn("_bit", F.bitmap_bit_position(slot))

    maps = placed(wanted.select(key)).select("_map", "_bit").repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(_bit div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    held = F.expr("cast(_bit % 8 as int)")
    found = F.get(F.array(*[F.shiftright(byte, i).bitwiseAND(1) for i in range(8)]), held) == 1
    some = placed(rows).join(F.broadcast(maps), "_map").where(found)
    none = placed(rows).join(F.broadcast(maps), "_map", "left").where(~F.coalesce(found, F.lit(False)))
    return some.select(rows.columns), none.select(rows.columns)


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be in ``wanted``: all that are, and few others. It spares the texts of most others a shuffle."""
    return split(rows, key, wanted)[0]


def cell_texts(docs: DataFrame, known: DataFrame, shared: DataFrame, size: int) -> DataFrame:
    """Stored ``node, n, text, s0, s1, ...`` of all sets in shared cells: a text is several times smaller than its set
    of hashes. A node has more than one row only if rows that share its id have texts that differ in case or white space."""
    first = known.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = store(shared.select(F.explode(F.array("pivot", "node")).alias("node")).distinct().join(first, "node"), "cell-nodes")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            sets = shingle_sets(piece.column(1).to_pylist(), size)
            own = [i for i, (n, s) in enumerate(zip(piece.column(0).to_pylist(), sets)) if node_of(s) == n]
            bits = np.array([sketch(sets[i]) for i in own], np.int64).reshape(len(own), len(SKETCH))
            found = piece.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [found.column(0), pa.array([len(sets[i]) for i in own], pa.int64()), found.column(1)] + [pa.array(c) for c in bits.T],
                names=["node", "n", "text", *SKETCH])

    texts = likely(docs.select("doc_id", "text"), "doc_id", wanted).join(wanted, "doc_id").dropDuplicates(["doc_id", "node", "text"]).select("node", "text")
    schema = "node long, n long, text string, " + ", ".join(f"{c} long" for c in SKETCH)
    return store(texts.mapInArrow(marks, schema), "cell-texts")


def may_link(x: str, y: str, percent: int):
    """Whether sizes and sketches (columns with prefixes ``x`` and ``y``) leave a link possible. Linked sets
    differ in at most (100 - percent) / (100 + percent) of their sizes' sum."""
    most = (F.col(f"{x}n") + F.col(f"{y}n")) * (100 - percent)
    bits = sum((F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in SKETCH), F.lit(0))
    return (F.abs(F.col(f"{x}n") - F.col(f"{y}n")) * (100 + percent) <= most) & (bits * (100 + percent) <= most)


def compared(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[float, bool]:
    """Jaccard distance of two sets, and whether they are linked."""
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    union = len(x) + len(y) - common
    return 1 - common / union, 100 * common >= percent * union


def distances(whole: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored ``a, b, distance, linked`` of the distinct ``pairs`` (a, b) of nodes, exactly, from the texts in ``whole``
    (node, text). Pairs meet in blocks: those of one ``b`` go to the block of its smallest ``a``, so that the texts of a
    group of near copies move about once, not once a pair. A block with more than ``LEADS`` sets as ``a`` is split by
    ``a``, one with more than ``FOLLOWERS`` of them as ``b`` by ``b``."""
    rows = pairs.groupBy("b").agg(F.min("a").alias("block"), F.collect_set("a").alias("partners"))
    heavy = (rows.select("block", F.col("b").alias("_b"), F.explode("partners").alias("_a")).groupBy("block")
             .agg(F.approx_count_distinct("_a").alias("x"), F.approx_count_distinct("_b").alias("y"))
             .where((F.col("x") > LEADS) | (F.col("y") > FOLLOWERS))
             .select("block", F.ceil(F.col("x") / LEADS).alias("ka"), F.ceil(F.col("y") / FOLLOWERS).alias("kb")))
    one = F.lit(1).cast("long")
    dealt = (rows.join(F.broadcast(heavy), "block", "left").withColumn("ka", F.coalesce("ka", one)).withColumn("kb", F.coalesce("kb", one))
             .withColumn("at_b", F.pmod(F.xxhash64("b"), "kb"))
             .withColumn("at_a", F.explode(F.sequence(one - 1, F.col("ka") - 1)))
             .withColumn("partners", F.expr("filter(partners, a -> pmod(xxhash64(a), ka) = at_a)")).where(F.size("partners") > 0))
    place = ["block", "at_a", "at_b"]
    ends = (dealt.select(*place, F.col("b").alias("node"), F.lit(False).alias("lead"), "partners")
            .unionByName(dealt.select(*place, F.explode("partners").alias("node"), F.lit(True).alias("lead"), F.lit(None).cast("array<long>").alias("partners"))))
    ends = ends.groupBy(*place, "node").agg(F.max("lead").alias("lead"), F.flatten(F.collect_list("partners")).alias("partners"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come block by block, the sets named by others first; those wait until all of them are there.
        block, leads, waiting, last = None, {}, [], None
        found: list[tuple] = []

        def test(node: int, s: np.ndarray, partners: list[int]) -> None:
            found.extend((a, node, *compared(leads[a], s, percent)) for a in partners)

        def settle() -> None:
            for row in waiting:
                test(*row)
            waiting.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*found)) or [(), (), (), ()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))],
                                              names=["a", "b", "distance", "linked"])

        for piece in text_slices(batches):
            *here, node, lead, partners = [piece.column(i).to_pylist() for i in range(6)]
            for at, n, first, named, s in zip(zip(*here), node, lead, partners, shingle_sets(piece.column(6).to_pylist(), size)):
                if at != block:
                    settle()
                    block, leads, last = at, {}, None
                if n == last:
                    continue  # an equal set under the same node
                last = n
                if first:
                    leads[n] = s
                    if named:
                        waiting.append((n, s, named))
                else:
                    settle()
                    test(n, s, named)
            yield out()
        settle()
        yield out()

    moved = whole.select("node", "text").join(ends, "node").select(*place, "node", "lead", "partners", "text")
    moved = moved.repartition(*place).sortWithinPartitions(*place, F.desc("lead"), "node")
    return store(moved.mapInArrow(compare, "a long, b long, distance double, linked boolean"), "distances")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (smallest node of the component) of all nodes of ``edges`` (a, b), by alternating
    stars of rising and falling neighbours; every round is stored."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = store(least.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "stars")
        # Done when every component is one star: no node has two edges downwards, or edges both ways.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down")))
        ways = ends.groupBy("x").agg(F.sum("down").alias("down"), F.min("down").alias("top"))
        if ways.where("down > 1 OR (down = 1 AND top = 0)").isEmpty():
            roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def linked_nodes(docs: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, root`` of the nodes that are linked with another one; ``known``: the sizes of ``docs``."""
    delta = 1 - percent / 100 + 1e-9
    shared = shared_cells(docs, size, percent)
    whole = cell_texts(docs, known, shared, size)
    marks = whole.select("node", "n", *SKETCH).dropDuplicates(["node"])
    tested = distances(whole, shared.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), size, percent)
    roots = components(tested.where("linked").select("a", "b"))
    # Members of cells where the first pivot has not settled everything, in shells around it.
    rest = shared.join(tested.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "distance"), ["pivot", "node"])
    rest = rest.select("cell", "node", "distance", F.floor(F.col("distance") / delta).alias("shell"))
    turn = F.row_number().over(Window.partitionBy("cell", "shell").orderBy("node"))
    done, had, take = tested.select("a", "b"), 0, PIVOTS
    while True:
        member = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = member.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("cell")
        member = member.join(mixed, "cell")
        member = store(member if had else member.withColumn("turn", turn), "open-cells")
        if member.isEmpty():
            break
        # A shell keeps its order, so those that were pivots before are not there any more.
        had += take
        take *= MORE
        pivot = member.where(F.col("turn") <= had)
        p = pivot.join(marks, "node").select("cell", F.col("node").alias("p"), F.col("distance").alias("pd"), F.col("root").alias("proot"),
                                             F.col("n").alias("p_n"), *[F.col(c).alias(f"p_{c}") for c in SKETCH])
        pairs = (member.join(marks, "node").join(p, "cell")
                 .where((F.col("node") != F.col("p")) & (F.col("root") != F.col("proot"))
                        & (F.abs(F.col("distance") - F.col("pd")) <= delta) & may_link("", "p_", percent))
                 .select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
                 .join(done, ["a", "b"], "left_anti"))
        pairs = store(pairs, "window-pairs")
        rest = member.where(F.col("turn") > had).drop("root")
        if not pairs.isEmpty():
            new = distances(whole, pairs, size, percent)
            done = done.unionByName(new.select("a", "b"))
            links = new.where("linked").select("a", "b")
            if not links.isEmpty():
                # what is known of a component is one star, so the edges stay few
                roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return roots


def near_classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``."""
    known = sizes(docs, size)
    roots = linked_nodes(docs, known, size, percent)
    grouped = known.where(F.col("doc_id").isNotNull()).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    node_class = grouped.select("node", "root").distinct().join(least, "root").select("node", "component_id")
    joined = known.join(node_class, "node", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"))


def row_classes(rows: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, key, class`` per row of ``rows`` (``doc_id, text, key``; the key is one of the row's id and text). Ids
    decide nothing here, null ones neither; a row without words has a class of its key."""
    own = rows.select(F.xxhash64("key").alias("doc_id"), "text", F.col("doc_id").alias("id"), "key")
    known = sizes(own, size, "id", "key")
    roots = linked_nodes(own, known, size, percent)
    node = F.coalesce("root", "node")
    return known.join(roots, "node", "left").select(
        F.col("id").alias("doc_id"), "key", F.when(node.isNull(), F.col("key")).otherwise(node.cast("string").cast("binary")).alias("class"))
