"""Breakdowns behind the dashboard charts.

Every function takes the (filtered) sales DataFrame and returns a small
aggregated DataFrame; nothing is collected.  Group keys that are null are
dropped before grouping (pandas ``groupby`` drops them, Spark keeps them).
All grouped sums use partial aggregation, so a key holding a third of the
rows is pre-combined inside each task before the shuffle.

Top-k results are ``orderBy(value desc, key asc).limit(k)``, which Spark runs
as TakeOrderedAndProject: each task keeps k rows, never a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date, month_label, month_start
from ..functions.numbers import rate, round_like_python
from ..schema import STATUS_CANCELLED, UNKNOWN, date_column, date_columns_ci, has


def _empty(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


def revenue_total(c: str = "revenue") -> F.Column:
    """``sum`` that is 0 for all-null / empty input, as DOUBLE."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def _dated(df: DataFrame, name: str | None = None) -> tuple[DataFrame, str] | None:
    """Rows with a parseable date in ``day``; ``None`` when there is no date column."""
    col = name or date_column(df)
    if col is None:
        return None
    return df.withColumn("__day", as_date(df, col)).where(F.col("__day").isNotNull()), col


def monthly_revenue(df: DataFrame) -> DataFrame:
    """B1: revenue per observed month, ascending (``month`` = ``yyyy-MM``)."""
    dated = _dated(df)
    if dated is None or not has(df, "revenue"):
        return _empty(df, "month string, revenue double")
    d, _ = dated
    return (d.groupBy(month_start(F.col("__day")).alias("__m"))
             .agg(revenue_total().alias("revenue"))
             .select(month_label(F.col("__m")).alias("month"), "revenue")
             .orderBy("month"))


def _sum_by(df: DataFrame, key: str) -> DataFrame:
    return (df.where(F.col(key).isNotNull())
              .groupBy(key).agg(revenue_total().alias("revenue")))


def revenue_by_category(df: DataFrame) -> DataFrame:
    """B2."""
    if not has(df, "category", "revenue"):
        return _empty(df, "category string, revenue double")
    return _sum_by(df, "category").orderBy("category")


def revenue_by_region(df: DataFrame) -> DataFrame:
    """Revenue per region and its share of the total in percent.

    The share window runs over the per-region aggregate (one row per
    region), never over raw rows.
    """
    if not has(df, "region", "revenue"):
        return _empty(df, "region string, revenue double, share_pct double")
    agg = (df.where(F.col("region").isNotNull()).groupBy("region")
             .agg(F.coalesce(F.sum("revenue"), F.lit(0)).alias("__r")))
    total = F.sum("__r").over(Window.partitionBy())  # exact when revenue is DECIMAL
    return agg.select("region", F.col("__r").cast("double").alias("revenue"),
                      rate(F.col("__r"), total).alias("share_pct")).orderBy("region")


def _count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def payment_method_counts(df: DataFrame) -> DataFrame:
    """Rows per payment method (column ``orders`` as in the chart)."""
    if not has(df, "payment_method"):
        return _empty(df, "payment_method string, orders bigint")
    return _count_by(df, "payment_method", "orders").orderBy("payment_method")


def order_status_counts(df: DataFrame) -> DataFrame:
    """Rows per order status."""
    if not has(df, "order_status"):
        return _empty(df, "order_status string, count bigint")
    return _count_by(df, "order_status", "count").orderBy("order_status")


def top_by_revenue(df: DataFrame, key: str, k: int) -> DataFrame:
    """Top-k keys by summed revenue (ties: key ascending)."""
    return _sum_by(df, key).orderBy(F.desc("revenue"), F.asc(key)).limit(k)


def top_products(df: DataFrame, k: int = 10) -> DataFrame:
    """Top-10 products by revenue."""
    if not has(df, "product", "revenue"):
        return _empty(df, "product string, revenue double")
    return top_by_revenue(df, "product", k)


def daily_revenue(df: DataFrame) -> DataFrame:
    """Revenue per calendar day (``day`` DATE), ascending."""
    dated = _dated(df)
    if dated is None or not has(df, "revenue"):
        return _empty(df, "day date, revenue double")
    d, _ = dated
    return d.groupBy(F.col("__day").alias("day")).agg(revenue_total().alias("revenue")).orderBy("day")


def category_values(df: DataFrame) -> list[str]:
    """Distinct categories of rows with a region: the wide form's columns."""
    rows = (df.where(F.col("category").isNotNull() & F.col("region").isNotNull())
              .select("category").distinct().orderBy("category").collect())
    return [r[0] for r in rows]


def region_category_matrix(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """B8 wide: one row per region, one column per category, absent cells 0.

    Built from the grouped cells; any number of categories that a row can hold.
    """
    if not has(df, "region", "category", "revenue"):
        return _empty(df, "region string")
    cats = categories if categories is not None else category_values(df)
    cells = (df.where(F.col("region").isNotNull() & F.col("category").isNotNull())
             .groupBy("region", "category").agg(revenue_total().alias("revenue")))
    held = cells.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("category", "revenue"))).alias("__held"))
    cell = lambda c: F.coalesce(F.try_element_at("__held", F.lit(c)), F.lit(0.0))
    return held.select("region", *[cell(c).alias(c) for c in cats]).orderBy("region")


def region_category_long(df: DataFrame) -> DataFrame:
    """B8 long: (region, category, revenue) for every region x observed category.

    One grouped aggregate; the zero cells come from its own small result, where
    each region meets the list of all categories.
    """
    if not has(df, "region", "category", "revenue"):
        return _empty(df, "region string, category string, revenue double")
    cells = (df.where(F.col("region").isNotNull() & F.col("category").isNotNull())
             .groupBy("region", "category").agg(revenue_total().alias("revenue")))
    listed = cells.agg(F.collect_set("category")).scalar()
    held = (cells.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("category", "revenue"))).alias("__held"))
            .withColumn("__all", listed))
    return (held.select("region", "__held", F.explode("__all").alias("category"))
            .select("region", "category", F.coalesce(F.try_element_at("__held", F.col("category")), F.lit(0.0)).alias("revenue"))
            .orderBy("region", "category"))


def top_items(df: DataFrame, key: str, value: str | None = "revenue", k: int = 5) -> DataFrame:
    """Top-k of one dimension, as (dimension, rank, label, value).

    With a value column the value is its sum per key; without one it is the
    row count per key with null keys counted as ``Unknown``.
    """
    schema = "dimension string, rank int, label string, value double"
    if not has(df, key):
        return _empty(df, schema)
    if value is not None and has(df, value):
        agg = df.where(F.col(key).isNotNull()).groupBy(key).agg(revenue_total(value).alias("v"))
    else:
        agg = (df.select(F.coalesce(F.col(key).cast("string"), F.lit(UNKNOWN)).alias(key))
                 .groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("v")))
    top = agg.orderBy(F.desc("v"), F.asc(key)).limit(k)
    w = Window.orderBy(F.desc("v"), F.asc(key))  # over at most k rows
    return top.select(F.lit(key).alias("dimension"), F.row_number().over(w).alias("rank"),
                      F.col(key).cast("string").alias("label"), F.col("v").alias("value"))


BRIEF_DIMENSIONS = (("product", "revenue"), ("category", "revenue"), ("region", "revenue"), ("payment_method", None), ("order_status", None))


def brief_top_items(df: DataFrame, k: int = 5) -> DataFrame:
    """B10 + B11 as used by the KPI brief: three revenue and two count lists.

    One scan: one grouping-sets aggregate over all dimensions, then ranks on its
    groups, of which each task keeps ``k`` per dimension before they meet.
    """
    summed = {c: value is not None and has(df, value) for c, value in BRIEF_DIMENSIONS if c in df.columns}
    if not summed:
        return _empty(df, "dimension string, rank int, label string, value double")
    keys = list(summed)
    text = lambda c: F.col(c).cast("string") if summed[c] else F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
    revenue = F.col("revenue") if has(df, "revenue") else F.lit(None).cast("double")
    sets = (df.select(*[text(c).alias(c) for c in keys], revenue.alias("__r"))
            .groupingSets([[c] for c in keys], *keys)
            .agg(F.grouping_id().alias("__gid"), F.coalesce(F.sum("__r"), F.lit(0)).cast("double").alias("__r"), F.count(F.lit(1)).alias("__n")))
    only = {c: (1 << len(keys)) - 1 - (1 << len(keys) - 1 - i) for i, c in enumerate(keys)}
    pick = lambda value: F.coalesce(*[F.when(F.col("__gid") == only[c], value(c)) for c in keys])
    groups = sets.select(pick(lambda c: F.lit(c)).alias("dimension"), pick(lambda c: F.col(c)).alias("label"),
                         pick(lambda c: F.col("__r") if summed[c] else F.col("__n").cast("double")).alias("value"))
    order = Window.partitionBy("dimension").orderBy(F.desc("value"), F.asc("label"))
    return (groups.where(F.col("label").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("dimension", "rank", "label", "value"))


def preferred_payment(df: DataFrame) -> DataFrame:
    """Most used payment method and its row count (ties: name ascending)."""
    if not has(df, "payment_method"):
        return _empty(df, "payment_method string, transactions bigint")
    return (_count_by(df, "payment_method", "transactions")
            .orderBy(F.desc("transactions"), F.asc("payment_method")).limit(1))


def best_product(df: DataFrame) -> DataFrame:
    """Product with the largest revenue (ties: smallest name) and that revenue."""
    if not has(df, "product", "revenue"):
        return _empty(df, "product string, revenue double")
    return top_by_revenue(df, "product", 1)


def leading_category(df: DataFrame) -> DataFrame:
    """Top category, its revenue and its percent of total revenue."""
    if not has(df, "category", "revenue"):
        return _empty(df, "category string, revenue double, pct_of_total double")
    # Total over all rows (null categories included), from a scalar subquery.
    total = df.agg(revenue_total().alias("t")).scalar()
    top = top_by_revenue(df, "category", 1)
    return top.select("category", "revenue",
                      F.when(total > 0, rate(F.col("revenue"), total)).otherwise(0.0).alias("pct_of_total"))


def leading_region(df: DataFrame) -> DataFrame:
    """Region with the largest revenue and that revenue."""
    if not has(df, "region", "revenue"):
        return _empty(df, "region string, revenue double")
    return top_by_revenue(df, "region", 1)


def region_cancellation(df: DataFrame) -> DataFrame:
    """Cancellation rate per region, regions with a cancellation only, descending.

    One pass: ``count_if(cancelled) / count(*)`` per region (the rows of the
    inner equi-join of the two per-region counts).
    """
    if not has(df, "region", "order_status"):
        return _empty(df, "region string, cancelled bigint, total bigint, cancel_rate double")
    cancelled = F.lower(F.col("order_status")) == STATUS_CANCELLED
    agg = (df.where(F.col("region").isNotNull()).groupBy("region")
             .agg(F.count_if(cancelled).alias("cancelled"), F.count(F.lit(1)).alias("total"))
             .where(F.col("cancelled") > 0))
    return (agg.withColumn("cancel_rate", rate(F.col("cancelled"), F.col("total")))
               .orderBy(F.desc("cancel_rate"), F.asc("region")))


def monthly_history(df: DataFrame, months: int = 6) -> DataFrame:
    """The last ``months`` observed months, revenue rounded to 2 dp."""
    dated = _dated(df, date_columns_ci(df)[0] if date_columns_ci(df) else None)
    if dated is None or not has(df, "revenue"):
        return _empty(df, "period string, revenue double")
    d, _ = dated
    monthly = d.groupBy(month_start(F.col("__day")).alias("__m")).agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("__r"))
    last = monthly.orderBy(F.desc("__m")).limit(months)
    return (last.select(month_label(F.col("__m")).alias("period"),
                        round_like_python(F.col("__r"), 2).alias("revenue"))
                .orderBy("period"))


FILTER_DIMENSIONS = ("category", "region", "payment_method", "order_status")


def filter_options(df: DataFrame) -> DataFrame:
    """Sorted distinct values of the four filter dimensions, long form.

    One scan: each row fans out to its four (dimension, value) pairs and a
    distributed distinct (partial aggregation per task) keeps one of each.
    """
    dims = [d for d in FILTER_DIMENSIONS if d in df.columns]
    if not dims:
        return _empty(df, "dimension string, value string")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims
    ])).alias("o")).select("o.dimension", "o.value").where(F.col("value").isNotNull())
    return long.distinct().orderBy("dimension", "value")
