"""Shared aggregates of a cleaned transaction table: every KPI section reads these instead of the rows.

The columns that count are stored once in the shared checkpoint folder (unless the rows are persisted). From them the
rows are summed per invoice, and the invoices at the grains of the business itself, month, weekday, customer, country
and customer within country, stored one folder per grain, so that a section reads its own grain only; products are
summed apart, per product and invoice first. Distinct products and customers follow from the product and customer grains. A
further pass, made only if a percentile is asked for, stores how often each revenue value occurs; all percentiles of
all sections then come from one frequency table.

The KPI operators take a ``Grains`` wherever they take a cleaned table.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import money, ratio, safe_div
from tillroll.plans.quantiles import percentiles
from tillroll.schema import UNKNOWN_CUSTOMER
from tillroll.session import shuffle_partitions, store

# Key columns of each grain beside the business keys.
GRAINS: dict[str, tuple[str, ...]] = {
    "total": (), "month": ("Year", "Month"), "weekday": ("Weekday",), "customer": ("CustomerID",),
    "product": ("StockCode", "Description"), "country": ("Country",), "country_customer": ("Country", "CustomerID")}

ROWS_A_TASK = 500_000  # products and invoices form nearly as many pairs as there are rows, so this bounds a task's memory
ROWS_A_SHARE = 65_536  # rows without an invoice that are summed together
SHARES = 64  # shares of the invoices for each task, so that the tasks get about as many

PROBABILITIES = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def known(customer: Column | str = "CustomerID") -> Column:
    c = F.col(customer) if isinstance(customer, str) else customer
    return c.isNotNull() & (c != UNKNOWN_CUSTOMER)


class Grains:
    """Aggregates of ``rows`` per ``by`` group; ``only`` names the grains that are needed (all by default), ``with_values`` makes
    the frequencies of revenue values at once."""

    def __init__(self, rows: DataFrame, by: Sequence[str] = (), only: Sequence[str] = tuple(GRAINS), with_values: bool = False):
        self.by = list(by)
        self.sparkSession = rows.sparkSession
        keys = sorted({k for g in only for k in GRAINS[g]})
        # A business key may also be the key of a grain, so the grains' keys get names of their own.
        src = rows.select(*self.by, *[F.col(k).alias(f"g_{k}") for k in keys], "Revenue", "Quantity", "InvoiceNo", "InvoiceDate")
        level = rows.storageLevel
        self.rows = src if level.useMemory or level.useDisk else store(src, "grain-rows")
        work = {"product": self._product} if "product" in only else {}
        if others := [g for g in only if g != "product"]:
            work["invoice"] = lambda: self._by_invoice(others)
        with ThreadPoolExecutor(max_workers=2) as pool:  # independent jobs over the stored rows
            jobs = {name: pool.submit(job) for name, job in work.items()}
            if with_values:
                pool.submit(lambda: self.values).result()
            self._tables = {name: job.result() for name, job in jobs.items()}

    def _tasks(self, rows: DataFrame) -> int:
        """Tasks of ``ROWS_A_TASK`` rows each; 0 if the session's cores and shuffle partitions have no more rows than that."""
        n, spark = rows.count(), self.sparkSession
        return -(-n // ROWS_A_TASK) if n > ROWS_A_TASK * min(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)) else 0

    def _dealt(self, rows: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
        """The rows by ``keys`` and a share of the invoices, so that neither a hot key nor many rows without an invoice meet in
        one task; as they are if they are few."""
        rows = self.rows if rows is None else rows
        tasks = self._tasks(rows)
        if not tasks:
            return rows.withColumn("_share", F.lit(None).cast("bigint"))
        share = F.pmod(F.xxhash64("InvoiceNo"), F.lit(SHARES * tasks))
        run = -F.floor(F.monotonically_increasing_id() / ROWS_A_SHARE) - 1
        return rows.withColumn("_share", F.when(F.col("InvoiceNo").isNull(), run).otherwise(share)).repartition(tasks, *keys, "_share")

    def _per_invoice(self, rows: DataFrame, keys: Sequence[str], *figures: Column) -> DataFrame:
        """Figures per ``keys``, invoice and share: nearly as many groups as there are rows, those without an invoice in parts."""
        return self._dealt(rows, keys).groupBy(*keys, "InvoiceNo", "_share").agg(*figures)

    def _product(self) -> DataFrame:
        keys = [*self.by, *[f"g_{k}" for k in GRAINS["product"]]]
        sums = [F.sum("rev").alias("rev"), F.sum("qty").alias("qty")]
        pairs = self._per_invoice(self.rows, keys, F.sum("Revenue").alias("rev"), F.sum("Quantity").alias("qty"))
        if tasks := self._tasks(self.rows):  # products may be many as well; those of a task's rows are summed where they are
            parts = pairs.groupBy(*keys, "_share").agg(*sums, F.count("InvoiceNo").alias("tx"))
            whole = parts.repartition(tasks, *keys).groupBy(*keys).agg(*sums, F.sum("tx").alias("tx"))
        else:
            whole = pairs.groupBy(*keys).agg(*sums, F.count("InvoiceNo").alias("tx"))
        return store(whole, "grain-product")

    def _by_invoice(self, only: Sequence[str]) -> DataFrame:
        """The grains that all lines of an invoice share, as a rule: the rows are first summed per invoice and keys. An invoice
        with one set of keys counts once in each of its groups; the others are told apart by a distinct count."""
        keys = [f"g_{k}" for k in sorted({k for g in only for k in GRAINS[g]})]
        figures = ("rev", "valued", "n", "qty", "first", "last")
        per = store(self._per_invoice(
            self.rows, [*self.by, *keys], F.sum("Revenue").alias("rev"), F.count("Revenue").alias("valued"), F.count(F.lit(1)).alias("n"),
            F.sum("Quantity").alias("qty"), F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last")).drop("_share"), "invoices")
        several = store(self._per_invoice(per.where("InvoiceNo IS NOT NULL"), self.by, F.count(F.lit(1)).alias("_sets"))
                        .where("_sets > 1").drop("_share"), "invoices-in-several-groups")
        counted = _keyed(per, several, [*self.by, "InvoiceNo"])
        types = {f.name: f.dataType for f in per.schema.fields}

        def at(grains: Sequence[str]) -> Column:
            return F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), *[
                (F.col(k) if k.removeprefix("g_") in GRAINS[g] else F.lit(None).cast(types[k])).alias(k) for k in keys]) for g in grains]))

        def spread(df: DataFrame, *columns: str) -> DataFrame:
            return df.select(*self.by, *columns, at(only).alias("_at")).select(*self.by, *columns, "_at.*")

        alone = (F.col("InvoiceNo").isNotNull() & F.col("_sets").isNull()).cast("bigint").alias("tx")
        rows = spread(counted.select(*self.by, *keys, *figures, alone), *figures, "tx")
        shared = spread(counted.where("_sets IS NOT NULL"), "InvoiceNo").distinct().select(
            *self.by, "grain", *keys, *[F.lit(0 if c in ("valued", "n") else None).cast(types[c]).alias(c) for c in figures],
            F.lit(1).cast("bigint").alias("tx"))
        table = rows.unionByName(shared).groupBy(*self.by, "grain", *keys).agg(
            *[F.sum(c).alias(c) for c in ("rev", "valued", "n", "qty", "tx")], F.min("first").alias("first"), F.max("last").alias("last"))
        return store(table, "grains", ["grain"])

    def _grain(self, name: str) -> DataFrame:
        keys = [f"g_{k}" for k in GRAINS[name]]
        if name == "product":
            return self._tables["product"].select(*self.by, *keys, "rev", "qty", "tx")
        return self._tables["invoice"].where(F.col("grain") == name).select(
            *self.by, *keys, "rev", "valued", "n", "qty", "tx", "first", "last")

    def _one(self, df: DataFrame) -> DataFrame:
        """Without business keys a total is one row even of an empty table."""
        return df if self.by else self.sparkSession.range(1).select(F.lit(True).alias("_all")).join(
            F.broadcast(df), F.lit(True), "left").drop("_all")

    def rows_per_group(self) -> DataFrame:
        return self._grain("total").select(*self.by, "n")

    def totals(self) -> DataFrame:
        codes = self._grain("product").groupBy(*self.by).agg(F.count_distinct("g_StockCode").alias("_codes"))
        people = self._grain("customer").groupBy(*self.by).agg(F.count("g_CustomerID").alias("_people"))
        out = self._one(self._grain("total"))
        for part in (codes, people):
            out = out.crossJoin(F.broadcast(part)) if not self.by else _keyed(out, part, self.by)
        zero = F.lit(0).cast("bigint")
        return out.select(*self.by, F.col("rev").alias("_rev"), F.coalesce("tx", zero).alias("total_transactions"),
                          F.coalesce("_codes", zero).alias("total_products"), F.coalesce("_people", zero).alias("total_customers"),
                          F.col("qty").alias("_items"), F.col("first").alias("_start"), F.col("last").alias("_end"))

    def months(self) -> DataFrame:
        return self._grain("month").select(*self.by, F.col("g_Year").alias("Year"), F.col("g_Month").alias("Month"), F.col("rev").alias("_rev"))

    def weekdays(self) -> DataFrame:
        return self._grain("weekday").select(*self.by, F.col("g_Weekday").alias("weekday"), F.col("rev").alias("_sum"), F.col("n").alias("_n"),
                                             safe_div(F.col("rev").cast(T.DoubleType()), "valued").alias("_mean"))

    def customers(self) -> DataFrame:
        return self._grain("customer").where(known("g_CustomerID")).select(
            *self.by, F.col("g_CustomerID").alias("CustomerID"), F.col("rev").alias("_spent"), F.col("tx").alias("_tx"),
            F.col("qty").alias("_items"), F.col("last").alias("_last"))

    def products(self) -> DataFrame:
        return self._grain("product").where(F.col("g_StockCode").isNotNull() & F.col("g_Description").isNotNull()).select(
            *self.by, F.col("g_StockCode").alias("StockCode"), F.col("g_Description").alias("Description"),
            F.col("rev").alias("_rev"), F.col("qty").alias("_qty"), F.col("tx").alias("_tx"))

    def countries(self) -> DataFrame:
        people = (self._grain("country_customer").where("g_Country IS NOT NULL").groupBy(*self.by, "g_Country")
                  .agg(F.count("g_CustomerID").alias("_cust")))
        c = _keyed(self._grain("country").where("g_Country IS NOT NULL"), people, [*self.by, "g_Country"])
        return c.select(*self.by, F.col("g_Country").alias("Country"), F.col("rev").alias("_rev"), F.col("tx").alias("_tx"),
                        F.col("_cust"), F.col("qty").alias("_qty"))

    @cached_property
    def values(self) -> DataFrame:
        """Stored ``(by, Revenue, n)``: how often each revenue value occurs."""
        return store(self.rows.where(F.col("Revenue").isNotNull()).groupBy(*self.by, "Revenue").agg(F.count(F.lit(1)).alias("n")), "values")

    def spread(self) -> DataFrame:
        """``_min, _max, _mean, _std`` of row revenue per group."""
        x, n = F.col("Revenue").cast(T.DoubleType()), F.col("n")
        base = self.values.groupBy(*self.by).agg(F.min("Revenue").alias("_min"), F.max("Revenue").alias("_max"), F.sum("n").alias("_rows"))
        total = self._one(self._grain("total")).select(*self.by, safe_div(F.col("rev").cast(T.DoubleType()), "valued").alias("_mean"))
        base = base.crossJoin(F.broadcast(total)) if not self.by else _keyed(base, total, self.by)
        at = base.select(*self.by, "_mean")
        marked = self.values.crossJoin(F.broadcast(at)) if not self.by else _keyed(self.values, at, self.by)
        square = marked.groupBy(*self.by).agg(F.sum(n * (x - F.col("_mean")) * (x - F.col("_mean"))).alias("_sq"))
        out = base.crossJoin(F.broadcast(square)) if not self.by else _keyed(base, square, self.by)
        return out.withColumn("_std", F.sqrt(safe_div("_sq", F.nullif(F.col("_rows") - 1, F.lit(0))))).drop("_sq", "_rows")

    @cached_property
    def _quantiles(self) -> DataFrame:
        c, p = self.customers(), self.products()
        price = ratio(F.coalesce(safe_div(F.col("_rev").cast(T.DoubleType()), "_qty"), F.lit(0.0)))
        parts = [self.values.select(*self.by, F.lit("revenue").alias("_of"), F.col("Revenue").cast("double").alias("_v"), F.col("n").alias("_w")),
                 c.select(*self.by, F.lit("spend").alias("_of"), money("_spent").alias("_v"), F.lit(1).cast("bigint").alias("_w")),
                 p.select(*self.by, F.lit("price").alias("_of"), price.alias("_v"), F.lit(1).cast("bigint").alias("_w"))]
        every = parts[0].unionByName(parts[1]).unionByName(parts[2])
        names = [f"_q{i}" for i in range(len(PROBABILITIES))]
        return store(percentiles(every, "_v", PROBABILITIES, [*self.by, "_of"], names=names, weight="_w"), "quantiles")

    def prepare(self) -> None:
        """Store what the sections share and is made on first use."""
        self._quantiles  # noqa: B018

    def quantiles(self, of: str, wanted: dict[str, float]) -> DataFrame:
        """Percentiles of ``revenue`` (rows), ``spend`` (customers) or ``price`` (products) under the wanted names."""
        rows = self._quantiles.where(F.col("_of") == of)
        return self._one(rows.select(*self.by, *[F.col(f"_q{PROBABILITIES.index(p)}").alias(name) for name, p in wanted.items()]))


def _keyed(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])
