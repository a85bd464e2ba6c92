"""The monthly forecast for every value of a key at once (P1-P6 per key).

One scan, one exchange of raw rows and no join: each row counts at three levels
(all, its product, its category), summed in every task and then per (key, level,
name, month).  A name's months, at most the calendar span, then travel together; per
key the best product and category are kept with theirs, and the key's own months
give the spine with its dense index.  A key that holds a third of all rows is a few
sums per task by then.  The result for a key equals ``forecast`` over that key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, month_label, month_start
from ..functions.numbers import round_like_python
from ..schema import NOT_AVAILABLE, col, date_column, has
from .forecast import FORECAST_SCHEMA, MIN_MONTHS

# Decimals kept before a prediction is rounded, so that the last bit of a fit never decides a tie.
STEADY = 8


def _steady(c: Column) -> Column:
    return F.round(c, STEADY)


def forecast_by(df: DataFrame, key: str, periods: int = 3) -> DataFrame:
    """P6 per value of ``key``: the key, then the six forecast fields.

    Rows without a date or without a key take no part; a key with fewer than
    three observed months has no rows.
    """
    date_col = date_column(df)
    if date_col is None or not has(df, "revenue", key) or periods < 1:
        return df.sparkSession.createDataFrame([], f"`{key}` {_type_of(df, key)}, {FORECAST_SCHEMA}")
    with_product, with_category = has(df, "product", "quantity"), has(df, "category")
    text = lambda c, there: (F.col(c) if there else F.lit(None)).cast("string").alias(f"of_{c}")
    base = df.select(col(key).alias("k"), month_start(as_date(df, date_col)).alias("month"), F.col("revenue").alias("rev"),
                     (F.col("quantity") if with_product else F.lit(None)).cast("double").alias("qty"),
                     text("product", with_product), text("category", with_category))
    # bits of the grouping id: k, month, product, category; set when left out
    level = F.when(F.col("gid") == 0b0011, "all").when(F.col("gid") == 0b0001, "product").otherwise("category")
    cells = (base.where(F.col("month").isNotNull() & F.col("k").isNotNull())
             .groupingSets([["k", "month"], ["k", "month", "of_product"], ["k", "month", "of_category"]], "k", "month", "of_product", "of_category")
             .agg(F.grouping_id().alias("gid"), F.sum("rev").alias("rev"), F.sum("qty").alias("qty"))
             .select("k", "month", level.alias("level"),
                     F.coalesce("of_product", "of_category").alias("name"), "rev", "qty"))
    total = lambda v: F.coalesce(F.sum(v), F.lit(0)).cast("double")
    weight = F.when(F.col("level") == "product", total("qty")).otherwise(total("rev"))
    months = cells.groupBy("k", "level", "name").agg(weight.alias("v"), F.collect_list(F.struct("month", "rev", "qty")).alias("months"))

    def leader(of: str) -> Column:
        """The name of the largest total (ties: smallest name) with its months."""
        ranked = F.struct((-F.col("v")).alias("o"), F.col("name").alias("k"))
        return F.min_by(F.struct("name", "months"), F.when((F.col("level") == of) & F.col("name").isNotNull(), ranked)).alias(of)

    per_key = months.groupBy("k").agg(F.min_by("months", F.when(F.col("level") == "all", 0)).alias("spine"), leader("product"), leader("category"))
    value = lambda of, v: F.coalesce(F.try_element_at(F.map_from_entries(
        F.transform(F.col(of)["months"], lambda m: F.struct(m["month"], m[v]))), F.col("m")["month"]), F.lit(0)).cast("double")
    # One row per key and observed month from here on.
    rows = per_key.select("k", "product", "category", F.posexplode(F.array_sort("spine")).alias("x", "m")).select(
        "k", F.col("product")["name"].alias("top_product"), F.col("category")["name"].alias("top_category"),
        F.col("x").cast("double").alias("x"), F.col("m")["month"].alias("month"),
        F.coalesce(F.col("m")["rev"], F.lit(0)).cast("double").alias("y_rev"), value("product", "qty").alias("y_prod"),
        value("category", "rev").alias("y_cat"))
    fits = [f for y in ("y_rev", "y_prod", "y_cat") for f in (F.regr_slope(y, "x").alias(f"b_{y}"), F.regr_intercept(y, "x").alias(f"a_{y}"))]
    model = (rows.groupBy("k", "top_product", "top_category").agg(F.count(F.lit(1)).alias("n"), F.max("month").alias("last_month"), *fits)
             .where(F.col("n") >= MIN_MONTHS))
    steps = model.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    nxt = (F.col("n") - 1 + F.col("i")).cast("double")
    predict = lambda y: _steady(F.greatest(F.lit(0.0), F.col(f"a_{y}") + F.col(f"b_{y}") * nxt))
    # as in the single form: without the columns the leader is "N/A", with them it may be null
    named = lambda c, there: (F.col(c) if there else F.lit(NOT_AVAILABLE)).alias(c)
    return steps.select(
        F.col("k").alias(key), month_label(F.add_months("last_month", F.col("i"))).alias("period"),
        round_like_python(predict("y_rev"), 2).alias("predicted_revenue"), named("top_product", with_product),
        (F.bround(predict("y_prod"), 0).cast("bigint") if with_product else F.lit(0).cast("bigint")).alias("predicted_product_demand"),
        named("top_category", with_category),
        (round_like_python(predict("y_cat"), 2) if with_category else F.lit(0.0)).alias("predicted_category_revenue"))


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString() if name in df.columns else "string"
