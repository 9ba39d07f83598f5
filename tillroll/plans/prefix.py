"""Running totals, ranks and pages over a global order, spread over many tasks with one shuffle.

A window with ``orderBy`` but no (or a hot) ``partitionBy`` moves every row of a group into one task. Instead the rows are
range-partitioned on ``(by..., order...)`` and sorted, so that every partition holds one contiguous slice of the order (a hot
group is split across many slices). In the same pass each row gets its rank and running sum inside its slice, and the result
is stored in the shared checkpoint folder, so the slices' membership is fixed. Only the first group of a slice can have begun
in an earlier one; what it brings along is a table of one row per slice, which is broadcast.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from typing import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import shuffle_partitions, store


def _slices(df: DataFrame, order: Sequence[Column], by: Sequence[str], scale: int | None, n: int, name: str) -> DataFrame:
    """Stored rows with ``_pid`` (slice), ``_place`` in it, ``_lrank`` and, for a ``_v`` of that decimal scale, ``_lsum``: rank and running sum of
    their group inside the slice."""
    keys = [F.col(k) for k in by]
    at = [df.columns.index(k) for k in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, group, rank, total, seen = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            groups = list(zip(*[batch.column(i).to_pylist() for i in at])) if at else [()] * batch.num_rows
            with localcontext() as ctx:
                ctx.prec = 60
                values = [0] * batch.num_rows if scale is None else [
                    0 if v is None else int(v.scaleb(scale)) for v in batch.column(batch.num_columns - 1).to_pylist()]
                ranks, sums = [], []
                for g, v in zip(groups, values):
                    if g != group:
                        group, rank, total = g, 0, 0
                    rank += 1
                    total += v
                    ranks.append(rank)
                    sums.append(total)
                out = batch.append_column("_pid", pa.array([pid] * len(ranks), pa.int32())).append_column("_lrank", pa.array(ranks, pa.int64()))
                out = out.append_column("_place", pa.array(range(seen, seen + len(ranks)), pa.int64()))
                seen += len(ranks)
                if scale is not None:
                    out = out.append_column("_lsum", pa.array([Decimal(s).scaleb(-scale) for s in sums], pa.decimal128(38, scale)))
            yield out

    fields = [*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_lrank", T.LongType()), T.StructField("_place", T.LongType())]
    if scale is not None:
        fields.append(T.StructField("_lsum", T.DecimalType(38, scale)))
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    return store(ranged.mapInArrow(run, T.StructType(fields)), name)


def _brought(slices: DataFrame, by: Sequence[str], total: bool) -> DataFrame:
    """One row per slice whose first group has begun earlier: ``_pid, by..., _coff, _soff`` (rows and sum of the group before).
    The ends of the slices, one row each, are read to the driver: their first and last group and what the last one holds."""
    keys = F.struct(F.lit(0).alias("_"), *by)
    last = F.max_by(F.struct(keys.alias("g"), "_lrank", *(["_lsum"] if total else [])), "_place")
    ends = slices.groupBy("_pid").agg(F.min_by(keys, "_place").alias("first"), last.alias("last")).orderBy("_pid").collect()
    rows, group, count, held = [], None, 0, Decimal(0)
    for e in ends:
        goes_on = group == e["first"]
        if goes_on:
            rows.append((e["_pid"], *list(e["first"])[1:], count, held if total else None))
        # The last group of this slice is the first one too if the slice holds no other.
        more = goes_on and e["first"] == e["last"]["g"]
        count = e["last"]["_lrank"] + (count if more else 0)
        if total:
            held = e["last"]["_lsum"] + (held if more else 0)
        group = e["last"]["g"]
    kinds = [slices.schema["_pid"], *[slices.schema[k] for k in by], T.StructField("_coff", T.LongType()),
             T.StructField("_soff", slices.schema["_lsum"].dataType if total else T.LongType())]
    return slices.sparkSession.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in kinds]))


def running_total(df: DataFrame, order: Sequence[Column], value: Column | str | None = None,
                  by: Sequence[str] = (), num_partitions: int | None = None, totals: bool = True) -> DataFrame:
    """Add ``_rank`` (1-based row number) within each ``by`` group, ordered by ``order``; for a ``value`` also ``_running``
    (inclusive running sum, as decimal) and with ``totals`` ``_group_rows`` and ``_group_total``.

    ``order`` must be a total order (end with a unique key) for the result to be
    deterministic. ``by`` keys must be non-null.
    """
    by = list(by)
    scale = None
    if value is not None:
        v = F.col(value) if isinstance(value, str) else value
        kind = df.select(v.alias("_v")).schema["_v"].dataType
        scale = kind.scale if isinstance(kind, T.DecimalType) else 0
        df = df.withColumn("_v", v.cast(T.DecimalType(38, scale)))
    columns = [c for c in df.columns if c != "_v"]
    slices = _slices(df, order, by, scale, num_partitions or shuffle_partitions(df.sparkSession), "ordered")
    # One row per slice at most; groups are compared null-safe by their slice and key.
    out = slices.join(F.broadcast(_brought(slices, by, value is not None)), ["_pid", *by], "left")
    added = {"_rank": F.col("_lrank") + F.coalesce("_coff", F.lit(0))}
    if value is not None:
        added["_running"] = F.col("_lsum") + F.coalesce("_soff", F.lit(0))
    out = out.withColumns(added)
    if totals:
        sums = [F.count(F.lit(1)).alias("_group_rows")] + ([F.sum("_v").alias("_group_total")] if value is not None else [])
        whole = slices.groupBy(*by).agg(*sums)
        out = out.join(whole, by) if by else out.crossJoin(F.broadcast(whole))
        added |= {c: None for c in whole.columns if c not in by}
    return out.select(*columns, *added)


class PageIndex:
    """A listing stored in its order, one folder per slice, with the rows of each slice: a page at any offset, or after any
    row, reads the slices it lies in. ``order`` names non-null columns with ``True`` for descending; they must be a key."""

    def __init__(self, df: DataFrame, order: dict[str, bool], num_partitions: int | None = None):
        self.order = order
        self.columns = df.columns
        cols = self._sort()
        spark = df.sparkSession
        ranged = df.repartitionByRange(num_partitions or shuffle_partitions(spark), *cols).sortWithinPartitions(*cols)
        # The number of a row holds its partition and its place in it.
        placed = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumns(
            {"_slice": F.shiftright("_at", 33).cast("int"), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
        self.table = store(placed, "pages", partition_by=["_slice"])
        ends = (self.table.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*order), "_place").alias("last"))
                .orderBy("_slice").collect())  # one row per slice
        self.slices = [(r["_slice"], r["n"], tuple(r["last"])) for r in ends]

    def _sort(self) -> list[Column]:
        return [F.col(c).desc() if down else F.col(c).asc() for c, down in self.order.items()]

    def total(self) -> int:
        return sum(n for _, n, _ in self.slices)

    def page(self, skip: int, limit: int) -> DataFrame:
        """Rows ``skip + 1`` to ``skip + limit`` with their ``position``."""
        starts, at, wanted = {}, 0, []
        for s, n, _ in self.slices:
            starts[s] = at
            if at < skip + limit and at + n > skip:
                wanted.append(s)
            at += n
        before = F.create_map(*[F.lit(x) for s in wanted for x in (s, starts[s])]) if wanted else F.create_map(F.lit(0), F.lit(0))
        rows = self.table.where(F.col("_slice").isin(wanted))  # prunes folders
        rows = rows.withColumn("position", (before[F.col("_slice")] + F.col("_place") + 1).cast("bigint"))
        return rows.where((F.col("position") > skip) & (F.col("position") <= skip + limit)).select(*self.columns, "position")

    def _beyond(self, a: tuple, b: tuple) -> bool:
        for x, y, down in zip(a, b, self.order.values()):
            if x != y:
                return (x < y) if down else (x > y)
        return False

    def after(self, last: Sequence, limit: int) -> DataFrame:
        """The ``limit`` rows after the row with the order values ``last``, by a seek predicate on the slices from there on."""
        here = [i for i, (_, _, end) in enumerate(self.slices) if self._beyond(end, tuple(last))][:1]
        if not here:
            return self.table.limit(0).select(*self.columns)
        # The first of them may end before the page does, so slices are added until they hold enough rows.
        wanted, held = [self.slices[here[0]][0]], 0
        for s, n, _ in self.slices[here[0] + 1:]:
            if held >= limit:
                break
            wanted.append(s)
            held += n
        seek, same = F.lit(False), F.lit(True)
        for (c, down), v in zip(self.order.items(), last):
            seek = seek | (same & ((F.col(c) < F.lit(v)) if down else (F.col(c) > F.lit(v))))
            same = same & (F.col(c) == F.lit(v))
        return self.table.where(F.col("_slice").isin(wanted) & seek).orderBy(*self._sort()).limit(limit).select(*self.columns)
