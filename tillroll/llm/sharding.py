"""Shards of equal counts by balanced label propagation, with DataFrame operations alone.

Documents that share a ``link`` are linked (here: equal texts). Every document starts in the shard that a
hash gives it. In each round every link counts its members by shard, and members outside its largest
shard ask to move there. A shard admits movers up to its quota plus ``SLACK`` and the room that leavers
make, so the share of admitted movers is one number per shard; a link moves as a whole unless it is large
against a quota, in which case its members are admitted one by one. Each round is stored.

At the end the counts are made exact (law ``rows``: at most one apart). Documents are ranked within their
shard, linked ones first, by bucketed running counts, so that no window holds a shard; the ones beyond the
quota, unlinked as far as there are any, fill the free slots of other shards.

Only counts per shard (and pairs of shards) reach the driver. Defined results: a null text has size 1,
checksum 0 and no link; an empty text is linked with other empty texts; repeated rows are separate members;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import store

SHARDS, ROUNDS, SLACK = 8, 3, 0.05
WHOLE_SHARE = 0.02     # links above this share of a quota move member by member
BUCKET_ROWS = 10_000


def facts(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, link`` with equal links for equal texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.sha2(F.col("text"), 256))).alias("link"))


def _unit(*cols: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _pick(values: list, index: Column, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), index)


def _counts(state: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
    return [got.get(s, 0) for s in range(shards)]


def propagate(state: DataFrame, shards: int, rounds: int, slack: float) -> DataFrame:
    """Move linked members of ``state`` (doc_id, ..., link, mix, linked, shard) towards their links' shards."""
    for turn in range(rounds):
        counts = _counts(state, shards)
        quota = sum(counts) / shards
        tally = state.where("linked").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        target = tally.groupBy("link").agg(
            F.max_by("shard", F.struct("n", F.xxhash64("link", "shard"))).alias("target"), F.sum("n").alias("group_size"))
        asked = tally.join(target, "link").where("shard <> target").groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()
        if not asked:
            return state
        into, out = [0] * shards, [0] * shards
        for r in asked:
            into[r["target"]] += r["n"]
            out[r["shard"]] += r["n"]
        room = [max(0.0, quota * (1 + slack) - counts[s] + 0.5 * out[s]) for s in range(shards)]
        admit = [min(1.0, room[s] / into[s]) if into[s] else 0.0 for s in range(shards)]
        whole = F.col("group_size") <= WHOLE_SHARE * quota
        draw = F.when(whole, _unit("link", F.lit(turn))).otherwise(_unit("mix", F.lit(turn)))
        goes = F.col("target").isNotNull() & (draw < _pick(admit, F.col("target"), "double"))
        # a link without strays asks for nothing, so its members need no join
        stray = tally.join(target, "link").groupBy("link").agg(F.first("target").alias("target"), F.first("group_size").alias("group_size"),
                                                             F.max((F.col("shard") != F.col("target")).cast("int")).alias("_s")).where("_s = 1").drop("_s")
        moved = state.join(stray, "link", "left").withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard")))
        state = store(moved.drop("target", "group_size"), f"shards-{turn}")
    return state


def settle(state: DataFrame, shards: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact counts: add ``slot`` and move the members beyond a quota to free slots."""
    counts = _counts(state, shards)
    total = sum(counts)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    over = [max(0, c - q) for c, q in zip(counts, quota)]
    free = [max(0, q - c) for c, q in zip(counts, quota)]
    buckets = max(1, -(-total // (shards * bucket_rows)))
    d = state.withColumn("_b", F.when(F.col("linked"), 0).otherwise(buckets) + F.floor(_unit("mix", F.lit("rank")) * buckets))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("shard", "_b").orderBy("mix", "doc_id", "size", "text_crc32")
    d = d.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, ["shard", "_b"]).withColumn("_rank", F.col("_r") + F.col("_off"))
    sums = lambda xs: [sum(xs[:i]) for i in range(len(xs))]
    spill = F.col("_rank") - _pick(quota, F.col("shard"), "long") + _pick(sums(over), F.col("shard"), "long")
    to = sum((F.when(spill >= x, 1).otherwise(0) for x in [a + b for a, b in zip(sums(free), free)]), F.lit(0))
    stays = F.col("_rank") < _pick(quota, F.col("shard"), "long")
    d = d.withColumn("_to", to).withColumn("_spill", spill)
    return (d.withColumn("slot", F.when(stays, F.col("_rank")).otherwise(
                F.col("_spill") - _pick(sums(free), F.col("_to"), "long") + _pick(counts, F.col("_to"), "long")).cast("long"))
            .withColumn("shard", F.when(stays, F.col("shard")).otherwise(F.col("_to")).cast("int"))
            .drop("_b", "_r", "_off", "_rank", "_to", "_spill"))


def assign(items: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``items`` (doc_id, size, text_crc32, link) with ``shard`` and ``slot``."""
    d = items.withColumn("mix", F.xxhash64("doc_id", "link"))
    shared = d.where("link IS NOT NULL").groupBy("link").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    start = (d.join(shared, "link", "left").withColumn("linked", F.col("_n").isNotNull()).drop("_n")
             .withColumn("shard", F.pmod("mix", F.lit(shards)).cast("int")))
    return settle(propagate(store(start, "shards-start"), shards, rounds, slack), shards)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return assign(store(facts(docs), "shard-facts"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(assigned: DataFrame, group: str) -> DataFrame:
    """Per group its rows and the rows outside its largest shard: what the assignment cuts."""
    tally = assigned.groupBy(group, "shard").agg(F.count(F.lit(1)).alias("n"))
    return tally.groupBy(group).agg(F.sum("n").alias("rows"), (F.sum("n") - F.max("n")).alias("cut"))
