"""Exact percentiles per group (linear interpolation between closest ranks, with NumPy's arithmetic).

One lazy plan serves every size, and no task ever holds a whole group:

1. ``(by, value) -> count`` by a partial aggregate, so a hot value is one row.
2. The values are cut into slices at approximate quantiles of that table: a one-row aggregate, found
   again by binary search. The slice of a value is a pure function of it and of that row.
3. Slice totals and a window over the small slice table tell which slices hold a wanted rank. All
   other slices are dropped by a join.
4. Running counts inside the kept slices give the two values around each rank.

``accuracy`` switches to the approximate sketch (``percentile_approx``) instead.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import shuffle_partitions

SKETCH_ACCURACY = 10_000  # least accuracy of the slice boundaries; four times the slices beyond that


def percentiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                names: Sequence[str] | None = None, accuracy: int | None = None,
                slices: int | None = None, weight: str | None = None) -> DataFrame:
    """One row per ``by`` group (a null key is a group) with one DOUBLE column per probability. Nulls
    in ``col`` do not count; ``weight`` names a column that tells how often a row counts; without ``by`` there is always one row, of NULLs if there are no values."""
    by = list(by)
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    v = F.col(col).cast("double")
    if accuracy is not None:
        parr = F.array(*[F.lit(float(p)) for p in probs])
        r = df.groupBy(*by).agg(F.percentile_approx(v, parr, F.lit(accuracy)).alias("_p"))
        return r.select(*by, *[F.col("_p")[i].cast("double").alias(n) for i, n in enumerate(names)])

    freq = df.where(v.isNotNull()).groupBy(*by, v.alias("_x")).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    sliced = with_slices(freq, slices or shuffle_partitions(df.sparkSession))

    totals = sliced.groupBy(*by, "_s").agg(F.sum("_n").alias("_t"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_s", "_t", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"),
                            F.sum("_t").over(group).alias("_rows"))
    places = [f((F.col("_rows") - 1) * float(p)) for p in probs for f in (F.floor, F.ceil)]
    wanted = offsets.where(reduce(Column.__or__, [(p >= F.col("_off")) & (p < F.col("_off") + F.col("_t"))
                                                  for p in places]))
    wanted = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
                           F.col("_s").alias("_slice"), "_off", "_rows")
    # Without keys at most two slices per probability are wanted.
    ranked = sliced.join(wanted if by else F.broadcast(wanted),
                         reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)],
                                F.col("_s") == F.col("_slice")))

    inside = Window.partitionBy(*by, "_s").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_off") + F.col("_run")
    picks = [F.max(F.when((place >= end - F.col("_n")) & (place < end), F.col("_x"))).alias(f"_x{i}")
             for i, place in enumerate(places)]
    picked = (ranked.withColumn("_run", F.sum("_n").over(inside)).groupBy(*by)
              .agg(F.max("_rows").alias("_rows"), *picks))
    return picked.select(*by, *[between(F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}"), (F.col("_rows") - 1) * float(p)).alias(n)
                                for i, (p, n) in enumerate(zip(probs, names))])


def percentiles_of(df: DataFrame, wanted: dict[str, dict[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Percentiles of several columns in one pass: ``{column: {name: probability}}``. One row per
    ``by`` group that has a value in any of the columns."""
    probs = sorted({p for names in wanted.values() for p in names.values()})
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(wanted)])))
    found = percentiles(long, "_v", probs, [*by, "_c"], names=[f"_q{j}" for j in range(len(probs))])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_c") == i, F.col(f"_q{probs.index(p)}"))).alias(name)
                                    for i, names in enumerate(wanted.values()) for name, p in names.items()])


def with_slices(values: DataFrame, slices: int) -> DataFrame:
    """Add ``_s``, the slice of ``_x``: about as many rows in each, whatever their groups. The broadcast
    side is one row with an array of at most ``slices`` numbers. Both sides use ``_n``, so that Spark makes the frequencies
    once: without it the cuts would prune the count and need an exchange of their own."""
    cuts = values.agg(F.percentile_approx(F.when(F.col("_n") > 0, F.col("_x")), F.array(*[F.lit(i / slices) for i in range(1, max(slices, 2))]),
                                          F.lit(max(SKETCH_ACCURACY, 4 * slices))).alias("_cuts"))
    return search(values.crossJoin(F.broadcast(cuts)), "_x", "_cuts", "_s", slices.bit_length()).drop("_cuts")


def search(df: DataFrame, x: str, ordered: str, name: str, steps: int) -> DataFrame:
    """Add ``name``: how many numbers of the ordered array are below ``x``, by binary search. Each step is a column over the
    one before, which stays in generated code; a fold over the steps would be interpreted for every row."""
    out = df.withColumn(name, F.lit(0))
    for size in (1 << i for i in reversed(range(steps))):
        below = F.get(F.col(ordered), F.col(name) + F.lit(size - 1)) < F.col(x)
        out = out.withColumn(name, F.when(below, F.col(name) + F.lit(size)).otherwise(F.col(name)))
    return out


def between(lo: Column, hi: Column, place: Column) -> Column:
    """The value at a fractional rank: counted from the nearer neighbour, so that both ends are met."""
    part = place - F.floor(place)
    return F.when(part < 0.5, lo + (hi - lo) * part).otherwise(hi - (hi - lo) * (1 - part))
