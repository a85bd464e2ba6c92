"""Mergeable sketches per month: opt-in estimates of K2, customers and revenue quantiles.

Each month holds one sketch of its order ids, one of its customers (HyperLogLog) and
one of its revenues (KLL quantiles).  Sketches of any months merge to that of their
union, so a date filter reads a few hundred small rows and no sales row.  Parts are
kept like the sums of ``rollups`` and grow by batches in the same way.

Bounds: a distinct count is off by more than ``DISTINCT_ERROR`` (relative) in fewer
than one of a thousand cases, a quantile's rank by more than ``RANK_ERROR``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import as_date, month_label
from ..schema import date_column
from . import rollups

LOG_BUCKETS = 14
QUANTILE_K = 400
# 3.3 standard errors of 1.04 / sqrt(2^LOG_BUCKETS).
DISTINCT_ERROR = 0.027
RANK_ERROR = 0.02
SCHEMA = "month string, n bigint, revenue decimal(38,4), orders binary, customers binary, revenues binary"


def sketch_sums(df: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` per month of canonical sales rows."""
    month = F.coalesce(month_label(as_date(df, date_column(df))), F.lit(rollups.UNDATED))
    return df.groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("revenue").cast("decimal(28,4)")).cast("decimal(38,4)").alias("revenue"),
        F.hll_sketch_agg("order_id", LOG_BUCKETS).alias("orders"), F.hll_sketch_agg("customer_name", LOG_BUCKETS).alias("customers"),
        F.kll_sketch_agg_double(F.col("revenue").cast("double"), QUANTILE_K).alias("revenues"))


def add(spark: SparkSession, root: str, df: DataFrame, batch: str, replace: bool = False) -> list[str]:
    return rollups.add(spark, root, df, batch, replace, make=sketch_sums)


def estimates(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row for the months from ``start`` to ``end``: exact rows and revenue, estimated distinct counts and quantiles."""
    kept = rollups.read_parts(spark, root, SCHEMA, start, end)
    merged = kept.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("total_revenue"),
        F.hll_union_agg("orders").alias("orders"), F.hll_union_agg("customers").alias("customers"),
        F.kll_merge_agg_double("revenues").alias("revenues"))
    count = lambda c: F.when(F.col("row_count") > 0, F.hll_sketch_estimate(c)).otherwise(0)
    at = lambda q: F.when(F.col("row_count") > 0, F.kll_sketch_get_quantile_double("revenues", F.lit(q)))
    return merged.select("row_count", "total_revenue", count("orders").alias("total_orders"), count("customers").alias("customers"),
                         at(0.5).alias("median_revenue"), at(0.95).alias("revenue_p95"))
