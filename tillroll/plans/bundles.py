"""Endpoint bundles (E1-E6): what one request computes, as DataFrames.

The dashboard bundle answers the monthly, daily, category, region, payment,
status and region x category breakdowns from ONE grouping-sets aggregate
(one scan, partial aggregation per task); the small rollup result is cached
for the charts that slice it.  The KPI card and the insights share one
cached one-row aggregate.  Top-k and the forecast are their own aggregates
over the same filtered scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, month_label, month_start
from ..operators import breakdowns as B
from ..operators.filters import SalesFilter, apply_filters, date_presets
from ..operators.forecast import forecast, forecast_confidence
from ..operators.insights import insights_from
from ..operators.kpis import KPI_COLUMNS, kpi_card, kpi_card_with_leaders
from ..operators.paging import first_rows, page
from ..schema import date_column

# Key under which a bundle lists the small aggregates it cached.
CACHED = "_cached"

ROLLUP_SCHEMA = "breakdown string, key string, key2 string, revenue double, row_count bigint"

# Breakdown name -> grouping columns.
ROLLUP_LEVELS = {
    "month": ("k_month",),
    "day": ("k_day",),
    "category": ("category",),
    "region": ("region",),
    "payment_method": ("payment_method",),
    "order_status": ("order_status",),
    "region_category": ("region", "category"),
    "total": (),
}


def _restrict(spec: SalesFilter | None, *fields: str) -> SalesFilter | None:
    if spec is None:
        return None
    return SalesFilter(**{f: getattr(spec, f) for f in fields})


def _canonical(df: DataFrame) -> DataFrame:
    return df.drop("order_month") if "order_month" in df.columns else df


# --- fixed values: breakdown to chart name --------------------------------
CHARTS = {"month": "monthly_trend", "category": "category_rev", "region": "region_rev", "payment_method": "payment_methods"}


def dashboard_rollup(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One scan -> (breakdown, key, key2, revenue, row_count) for B1-B5, B7, B8 and totals, or for some of them."""
    levels = {n: cols for n, cols in ROLLUP_LEVELS.items() if names is None or n in names}
    if not levels:
        return df.sparkSession.createDataFrame([], ROLLUP_SCHEMA)
    date_col = date_column(df)
    day = as_date(df, date_col) if date_col else F.lit(None).cast("date")
    base = df.select(
        month_label(month_start(day)).alias("k_month"), F.date_format(day, "yyyy-MM-dd").alias("k_day"),
        *[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c)
          for c in ("category", "region", "payment_method", "order_status")],
        (F.col("revenue") if "revenue" in df.columns else F.lit(None).cast("double")).alias("revenue"))
    keys = ["k_month", "k_day", "category", "region", "payment_method", "order_status"]
    sets = [list(cols) for cols in levels.values()]
    grouped = base.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("gid"), F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("revenue"),
        F.count(F.lit(1)).alias("row_count"))
    out = None
    for name, cols in levels.items():
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in cols)
        cond = F.col("gid") == gid
        for c in cols:
            cond = cond & F.col(c).isNotNull()
        key = F.col(cols[0]) if cols else F.lit(None).cast("string")
        key2 = F.col(cols[1]) if len(cols) > 1 else F.lit(None).cast("string")
        part = F.when(cond, F.struct(F.lit(name).alias("breakdown"), key.alias("key"), key2.alias("key2")))
        out = part if out is None else F.coalesce(out, part)
    return (grouped.select(out.alias("b"), "revenue", "row_count").where(F.col("b").isNotNull())
                   .select("b.breakdown", "b.key", "b.key2", "revenue", "row_count"))


def kpis_endpoint(df: DataFrame, spec: SalesFilter | None = None) -> DataFrame:
    """KPI card with date, category, region, payment and status filters."""
    f = _restrict(spec, "date_start", "date_end", "category", "region", "payment_method", "order_status")
    return kpi_card(apply_filters(df, f))


def charts_endpoint(df: DataFrame, spec: SalesFilter | None = None) -> DataFrame:
    """Monthly trend, category, region and payment charts as one long table
    (chart, label, value) with date, category and region filters, from one scan."""
    f = apply_filters(df, _restrict(spec, "date_start", "date_end", "category", "region"))
    charts = F.create_map(*[F.lit(x) for pair in CHARTS.items() for x in pair])
    counted = F.col("breakdown") == "payment_method"
    wanted = [c for c, there in (("month", date_column(f) and "revenue" in f.columns), ("category", "revenue" in f.columns and "category" in f.columns),
                                 ("region", "revenue" in f.columns and "region" in f.columns), ("payment_method", "payment_method" in f.columns)) if there]
    return dashboard_rollup(f, wanted).select(
        F.try_element_at(charts, F.col("breakdown")).alias("chart"), F.col("key").alias("label"),
        F.when(counted, F.col("row_count").cast("double")).otherwise(F.col("revenue")).alias("value"))


def orders_endpoint(df: DataFrame, product_search: str | None = None, category=None, limit: int = 50) -> DataFrame:
    """Filtered rows (product search, category), first ``limit``."""
    f = apply_filters(df, SalesFilter(product_search=product_search, category=category))
    return _canonical(first_rows(f, limit))


def forecast_endpoint(df: DataFrame) -> DataFrame:
    """Forecast over the unfiltered table."""
    return forecast(df)


def report_endpoint(df: DataFrame, spec: SalesFilter | None = None) -> dict[str, DataFrame]:
    """E5: KPI card and insights with date filters."""
    f = apply_filters(df, _restrict(spec, "date_start", "date_end"))
    row = kpi_card_with_leaders(f).cache()  # one row, shared by both results
    return {"kpis": row.select(*KPI_COLUMNS), "insights": insights_from(row), CACHED: [row]}


def report_insights(df: DataFrame, spec: SalesFilter | None = None) -> DataFrame:
    """E5's insights alone (date filters), without a cached shared row."""
    return insights_from(kpi_card_with_leaders(apply_filters(df, _restrict(spec, "date_start", "date_end"))))


def dashboard(df: DataFrame, spec: SalesFilter | None = None, page_number=1) -> dict[str, DataFrame]:
    """Everything the dashboard page shows, as lazy DataFrames.

    The rollup (bounded by months + days + categories x regions) is cached
    and sliced per chart.  Options and presets use the unfiltered table.
    """
    f = apply_filters(df, spec)
    rollup = dashboard_rollup(f).cache()

    def level(name: str, key: str, value: str = "revenue") -> DataFrame:
        return rollup.where(F.col("breakdown") == name).select(F.col("key").alias(key), value).orderBy(key)

    row = kpi_card_with_leaders(f).cache()  # one row: KPI card + insight inputs
    card = row.select(*KPI_COLUMNS)
    pairs = rollup.where(F.col("breakdown") == "region_category") \
        .select(F.col("key").alias("region"), F.col("key2").alias("category"), "revenue")
    return {
        "kpis": card,
        "monthly_trend": level("month", "month"),
        "category_rev": level("category", "category"),
        "region_rev": level("region", "region"),
        "payment_methods": level("payment_method", "payment_method", "row_count").withColumnRenamed("row_count", "orders"),
        "order_status": level("order_status", "order_status", "row_count").withColumnRenamed("row_count", "count"),
        "top_products": B.top_products(f),
        "daily_trend": level("day", "day"),
        "heatmap": B.region_category_long(pairs),
        "page": _canonical(page(f, page_number)),
        "filter_options": B.filter_options(df),
        "date_presets": date_presets(df),
        "insights": insights_from(row),
        "forecast": forecast(f),
        "forecast_meta": forecast_confidence(f),
        CACHED: [rollup, row],
    }


def release(bundle: dict) -> None:
    """Unpersist the shared aggregates of a bundle once its results are read."""
    for df in bundle.pop(CACHED, []):
        df.unpersist()
