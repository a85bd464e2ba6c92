"""Monthly linear-trend forecast.

Everything after the first aggregation runs on one row per observed month,
so the global window that numbers the months and the regression aggregates
see a calendar-bounded input, never raw rows.  The top product / category
are scalar subqueries (each a distributed top-1), and their monthly series
are conditional sums in the same monthly aggregate, which puts them on the
month spine with zeros for absent months without any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date, month_label, month_start
from ..functions.numbers import round_like_python
from ..schema import NOT_AVAILABLE, date_column, date_columns_ci, has

FORECAST_SCHEMA = ("period string, predicted_revenue double, top_product string, "
                   "predicted_product_demand bigint, top_category string, predicted_category_revenue double")
MIN_MONTHS = 3


def _empty(df: DataFrame, ddl: str = FORECAST_SCHEMA) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


def _top_key(d: DataFrame, key: str, value: str) -> Column:
    """Scalar subquery: key with the largest summed value (ties: smallest key)."""
    top = (d.where(F.col(key).isNotNull()).groupBy(key)
             .agg(F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("v"))
             .orderBy(F.desc("v"), F.asc(key)).limit(1).select(F.col(key).cast("string")))
    return top.scalar()


def monthly_series(df: DataFrame) -> tuple[DataFrame, dict[str, Column]] | None:
    """P1 + the series of P3 / P4: one row per observed month with its index, and the leaders' names.

    The names stay out of the aggregate over raw rows: a text buffer would make it sort them.
    """
    date_col = date_column(df)
    if date_col is None or not has(df, "revenue"):
        return None
    d = df.withColumn("__day", as_date(df, date_col)).where(F.col("__day").isNotNull())
    with_product = has(df, "product", "quantity")
    with_category = has(df, "category")
    aggs = [F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("y_rev")]
    if with_product:
        top_p = _top_key(d, "product", "quantity")
        aggs += [F.coalesce(F.sum(F.when(F.col("product") == top_p, F.col("quantity"))), F.lit(0))
                 .cast("double").alias("y_prod")]
    if with_category:
        top_c = _top_key(d, "category", "revenue")
        aggs += [F.coalesce(F.sum(F.when(F.col("category") == top_c, F.col("revenue"))), F.lit(0))
                 .cast("double").alias("y_cat")]
    monthly = d.groupBy(month_start(F.col("__day")).alias("month")).agg(*aggs)
    # Global window over one row per month (calendar-bounded).
    idx = (F.row_number().over(Window.orderBy("month")) - 1).cast("double")
    keys = {}
    if with_product:
        keys["top_product"] = top_p
    if with_category:
        keys["top_category"] = top_c
    return monthly.withColumn("x", idx), keys


def trend_fit(df: DataFrame) -> DataFrame:
    """OLS slope / intercept of monthly revenue on the month index."""
    series = monthly_series(df)
    if series is None:
        return _empty(df, "n_months bigint, slope double, intercept double")
    m, _ = series
    return m.agg(F.count(F.lit(1)).alias("n_months"),
                 F.regr_slope("y_rev", "x").alias("slope"),
                 F.regr_intercept("y_rev", "x").alias("intercept"))


def forecast(df: DataFrame, periods: int = 3) -> DataFrame:
    """Next ``periods`` calendar months of revenue, top-product demand and
    top-category revenue; empty with fewer than three observed months."""
    series = monthly_series(df)
    if series is None or periods < 1:
        return _empty(df)
    m, keys = series
    with_product, with_category = "top_product" in keys, "top_category" in keys
    fits = [F.count(F.lit(1)).alias("n"), F.max("month").alias("last_month"),
            F.regr_slope("y_rev", "x").alias("b_rev"), F.regr_intercept("y_rev", "x").alias("a_rev")]
    if with_product:
        fits += [F.regr_slope("y_prod", "x").alias("b_prod"), F.regr_intercept("y_prod", "x").alias("a_prod")]
    if with_category:
        fits += [F.regr_slope("y_cat", "x").alias("b_cat"), F.regr_intercept("y_cat", "x").alias("a_cat")]
    model = m.agg(*fits).where(F.col("n") >= MIN_MONTHS).withColumns(keys)
    steps = model.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("i"))
    nxt = (F.col("n") - 1 + F.col("i")).cast("double")

    def predict(a: str, b: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(a) + F.col(b) * nxt)

    return steps.select(
        month_label(F.add_months(F.col("last_month"), F.col("i"))).alias("period"),
        round_like_python(predict("a_rev", "b_rev"), 2).alias("predicted_revenue"),
        (F.col("top_product") if with_product else F.lit(NOT_AVAILABLE)).alias("top_product"),
        (F.bround(predict("a_prod", "b_prod"), 0).cast("bigint") if with_product
         else F.lit(0).cast("bigint")).alias("predicted_product_demand"),
        (F.col("top_category") if with_category else F.lit(NOT_AVAILABLE)).alias("top_category"),
        (round_like_python(predict("a_cat", "b_cat"), 2) if with_category
         else F.lit(0.0)).alias("predicted_category_revenue"),
    ).orderBy("period")


def forecast_series(df: DataFrame, periods: int = 3) -> DataFrame:
    """The (period, predicted_revenue) series behind the forecast chart."""
    return forecast(df, periods).select("period", "predicted_revenue")


# Fixed values.
CONFIDENCE_NOTES = {
    "Moderate": "Forecast is based on multiple historical months, but it still uses a simple linear trend.",
    "Low": "Forecast has the minimum history needed for trend regression. Treat it as directional.",
    "Unavailable": "At least 3 months of valid revenue history are required to generate a forecast.",
}


def forecast_confidence(df: DataFrame, history_months: int = 6) -> DataFrame:
    """Confidence label from the (at most six) months of history.

    The forecast has rows when its own date column holds three months, counted in the same pass.
    """
    names = date_columns_ci(df)
    own = date_column(df)
    if names and has(df, "revenue"):
        month = lambda c: month_start(as_date(df, c))
        months = df.agg(F.count_distinct(month(names[0])).alias("observed"),
                        (F.count_distinct(month(own)) if own is not None else F.lit(0)).alias("dated"))
    else:
        months = df.sparkSession.createDataFrame([(0, 0)], "observed bigint, dated bigint")
    count = F.least(F.col("observed"), F.lit(history_months))
    label = F.when(count >= 6, "Moderate").when(count >= 3, "Low").otherwise("Unavailable")
    note = F.when(count >= 6, CONFIDENCE_NOTES["Moderate"]).when(count >= 3, CONFIDENCE_NOTES["Low"]) \
        .otherwise(CONFIDENCE_NOTES["Unavailable"])
    return months.select(count.cast("bigint").alias("month_count"), label.alias("confidence"), note.alias("note"),
                         ((count >= 3) & (F.col("dated") >= MIN_MONTHS)).alias("has_enough_history"))
