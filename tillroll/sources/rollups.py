"""Partial aggregates per month, from which the dashboard is answered without the raw rows.

Every batch of sales rows is summed once, per month and level (all, month, day,
category, region, payment method, status, region x category, product, customer,
order), in one grouping-sets scan.  Sums and counts add up, so a batch only adds parts
for its own months: nothing else is read or written.  ``replace`` puts a batch in
place of all earlier parts of its months (a re-cleaned month).

A part is an immutable folder; what counts is a set of empty marker files, one per
part and month, whose names carry month, time, batch and kind.  A batch that was added
before is not added again, so a replay is harmless, and concurrent batches never touch
the same file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import as_date, month_label
from ..schema import STATUS_CANCELLED, STATUS_RETURNED, date_column
from . import versions

UNDATED = "undated"
PART_SCHEMA = ("month string, level string, k1 string, k2 string, revenue decimal(38,4), quantity double, n bigint, "
               "n_cancel bigint, n_return bigint")
# Level -> key columns (month is always one).
LEVELS = {
    "all": (), "day": ("day",), "category": ("category",), "region": ("region",), "payment_method": ("payment_method",),
    "order_status": ("order_status",), "region_category": ("region", "category"), "product": ("product",),
    "customer": ("customer_name",), "order": ("order_id",),
}


def partial_sums(df: DataFrame) -> DataFrame:
    """Rows of ``PART_SCHEMA`` from canonical sales rows: one scan, null keys kept as groups of their own."""
    day = as_date(df, date_column(df))
    keys = ["day", "category", "region", "payment_method", "order_status", "product", "customer_name", "order_id"]
    status = F.lower(F.col("order_status"))
    base = df.select(
        F.coalesce(month_label(day), F.lit(UNDATED)).alias("month"), F.date_format(day, "yyyy-MM-dd").alias("day"),
        *[F.col(c).cast("string").alias(c) for c in keys if c != "day"], F.col("revenue").cast("decimal(28,4)").alias("revenue"),
        F.col("quantity").cast("double").alias("quantity"), (status == STATUS_CANCELLED).alias("cancel"), (status == STATUS_RETURNED).alias("return"))
    sets = base.groupingSets([["month", *cols] for cols in LEVELS.values()], "month", *keys).agg(
        F.grouping_id().alias("gid"), F.sum("revenue").cast("decimal(38,4)").alias("revenue"), F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"),
        F.count(F.lit(1)).alias("n"), F.count_if("cancel").alias("n_cancel"), F.count_if("return").alias("n_return"))
    gid = {name: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in cols) for name, cols in LEVELS.items()}
    of = lambda pick: F.coalesce(*[F.when(F.col("gid") == gid[name], pick(cols)) for name, cols in LEVELS.items()])
    none = F.lit(None).cast("string")
    return sets.select("month", of_level(gid).alias("level"), of(lambda c: F.col(c[0]) if c else none).alias("k1"),
                       of(lambda c: F.col(c[1]) if len(c) > 1 else none).alias("k2"), "revenue", "quantity", "n", "n_cancel", "n_return")


def of_level(gid: dict[str, int]):
    return F.coalesce(*[F.when(F.col("gid") == bits, F.lit(name)) for name, bits in gid.items()])


def _markers(spark: SparkSession, root: str) -> list[tuple[str, str, str, str, str]]:
    """``(month, time, kind, batch, folder)`` of every marker, in order."""
    names = [n for n in versions.names_in(spark, f"{root}/parts") if not n.startswith((".", "_"))]
    return sorted(tuple(n.split("~")) for n in names)  # type: ignore[misc]


def add(spark: SparkSession, root: str, df: DataFrame, batch: str, replace: bool = False,
        make: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
    """Adds a batch of sales rows; returns the months that it touched (none if it was added before).

    ``make`` turns the rows into parts with a ``month`` column, by default the partial sums.
    """
    if any(m[3] == batch for m in _markers(spark, root)):
        return []
    at = versions._pointer_name()
    folder = f"data-{at}"
    sums = (make or partial_sums)(df).withColumn("order_month", F.col("month"))
    (sums.hint("rebalance", "order_month").sortWithinPartitions("order_month", *[c for c in ("level", "k1") if c in sums.columns]).write.partitionBy("order_month").parquet(f"{root}/{folder}"))
    months = sorted(n.split("=", 1)[1] for n in versions.names_in(spark, f"{root}/{folder}") if n.startswith("order_month="))
    for month in months:
        versions.write_small(spark, f"{root}/parts/{month}~{at}~{'replace' if replace else 'add'}~{batch}~{folder}", "")
    return months


def parts(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Folders that count, per month: those from the last replacement on.

    A batch counts once per month, also if two writers added it at the same time.
    """
    out: dict[str, list[str]] = {}
    seen: set[tuple[str, str]] = set()
    for month, _, kind, batch, folder in _markers(spark, root):
        if (month, batch) in seen:
            continue
        seen.add((month, batch))
        if kind == "replace":
            out[month] = []
        out.setdefault(month, []).append(f"{root}/{folder}/order_month={month}")
    return out


def read_parts(spark: SparkSession, root: str, schema: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The parts of the months from ``start`` to ``end`` (``yyyy-MM``); all of them without bounds."""
    paths = [p for month, folders in parts(spark, root).items() for p in folders
             if (start is None and end is None) or (month != UNDATED and (start or "") <= month <= (end or "9999-12"))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, levels: Iterable[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Partial sums of some levels, of the months from ``start`` to ``end``."""
    return read_parts(spark, root, PART_SCHEMA, start, end).where(F.col("level").isin(list(levels)))
