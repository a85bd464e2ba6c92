"""Registered queries: one callable per operator, ``(spark, sf_dir) -> DataFrame``.

Each reads the driver tables -- directly, or through the stored sales table
and its dirty variant, which Spark derives from them -- so its work grows
with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import preview
from ..operators import breakdowns as B
from ..operators import cleaning as C
from ..operators import forecast as P
from ..operators import insights as I
from ..operators import paging as L
from ..operators.filters import SalesFilter, apply_filters, date_presets
from ..operators.forecast_by import forecast_by
from ..operators.kpis import kpi_card
from ..sources import catalog as D
from ..sources.csv import read_sales_csv
from ..sources.sales import canonical, dirty_sales, dirty_sales_csv, load_sales, materialize_sales, sales_day_index, sales_rollups, sales_sketches
from ..sources.sinks import as_json
from ..sources.sketches import estimates
from ..session import derived_table_path
from ..sources.tables import read_table
from ..sources.versions import new_id
from . import bundles as E
from . import export as X
from .ingest import ingest
from .stored_dashboard import stored_dashboard

Query = Callable[[SparkSession, str], DataFrame]

# Filters of the KPI endpoint (dates, category, region, payment, status).
E1_FILTER = SalesFilter(
    date_start="1996-01-01", date_end="1999-06-30", category=["ECONOMY", "PROMO"],
    region=["ASIA", "EUROPE"], payment_method=["1-URGENT", "2-HIGH"],
    order_status=["Delivered", "Shipped", "Cancelled"])

# All nine dashboard filters at once.
F10_FILTER = SalesFilter(
    date_start="1996-01-01", date_end="1999-06-30", category=["ECONOMY", "PROMO"],
    region=["ASIA", "EUROPE"], payment_method=["1-URGENT", "2-HIGH"],
    order_status=["Delivered", "Shipped", "Cancelled"], revenue_min="5000", revenue_max="80000",
    product_search="^(Red|Blue|Hot) ")

# A range in which nothing was sold, and large sales among which few customers come again and many are cancelled.
NO_ROWS_FILTER = SalesFilter(date_start="1890-01-01", date_end="1890-12-31")
RISK_FILTER = SalesFilter(date_start="1997-01-01", date_end="1997-12-31", order_status=["Cancelled", "Shipped", "Pending"], revenue_min=90000)

# A list that no plan should carry: two categories that exist among 100,000 that do not.
LONG_FILTER = SalesFilter(category=["ECONOMY", "PROMO", *(f"EXTRA {i}" for i in range(100_000))], revenue_min="50000")

# Plain-text search: the point is a point.
LITERAL_FILTER = SalesFilter(product_search="red widget", product_literal=True, date_start="1998-01-01")

# Date window of the report endpoint.
REPORT_FILTER = SalesFilter(date_start="1997-01-01", date_end="1998-12-31")


def _on_sales(op) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(load_sales(spark, sf_dir))
    return run


# A day-first export: most of its dates read either way.
DAY_FIRST = "dd/MM/yyyy"


def _on_dirty(op, date_layout: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(dirty_sales(spark, sf_dir, date_layout))
    return run


def _rows(df: DataFrame) -> DataFrame:
    """Canonical row columns with revenue as DOUBLE."""
    out = canonical(df)
    return out.withColumn("revenue", out["revenue"].cast("double"))


def _trend_fit(df: DataFrame) -> DataFrame:
    fit = P.trend_fit(df)
    return fit.select("n_months", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def _recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.recent_activity(read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "customer"))


def _activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.system_counts(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "events"))


def _document_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", preview(F.col("text")).alias("preview"))


def _last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 at the far end of the whole table: a number out of range is the last page."""
    return _rows(L.page(load_sales(spark, sf_dir), 0, index=sales_day_index(spark, sf_dir)))


def _preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(L.preview(load_sales(spark, sf_dir), index=sales_day_index(spark, sf_dir)))


def _csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 -> S1 -> C16-C19: the dirty variant written as CSV, read back with
    type inference and profiled (equal to profiling the variant itself)."""
    return C.quality_report(read_sales_csv(spark, dirty_sales_csv(spark, sf_dir)))


def _catalog(spark: SparkSession, sf_dir: str) -> str:
    """A catalog of two uploads of the raw export, through the ingest gate: ISO dates, then (active) day-first dates."""
    stored = materialize_sales(spark, sf_dir)
    root = derived_table_path(spark, "catalog", f"uploads-v1|{stored}")
    there = {r["name"] for r in D.datasets(spark, root).select("name").collect()}
    for name, layout in (("export", None), ("export-dayfirst", DAY_FIRST)):
        if name not in there:
            ingest(spark, dirty_sales(spark, sf_dir, layout), root, f"{root}/stored/{name}-{new_id()}", name, owner="ops")
    return root


def _two_decimals(df: DataFrame) -> DataFrame:
    """Sums of DOUBLE columns depend on their order in the last bits; a card shows two decimals."""
    return df.select(*[F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _active_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the catalog's active dataset to the KPI card."""
    return _two_decimals(kpi_card(D.active_sales(spark, _catalog(spark, sf_dir))))


def _dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, C20 and the stored profile, read back from its JSON text."""
    stored = F.from_json("summary", D.PROFILE_SCHEMA)
    return D.list_datasets(spark, _catalog(spark, sf_dir), owner="ops", search="EXPORT", sort="name").select(
        "name", "owner", "row_count", "column_count", "quality_score", "quality_grade", "is_active",
        stored["total_rows"].alias("raw_rows"), stored["duplicate_count"].alias("duplicates"),
        stored["missing_values"]["Product Category"].alias("missing_categories"), F.size(stored["data_type_warnings"]).alias("warnings"))


def _newest_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest upload first."""
    order = F.row_number().over(Window.orderBy(F.desc("uploaded_at"), F.asc("dataset_id")))  # a row per upload
    return D.newest_first(D.datasets(spark, _catalog(spark, sf_dir)), "uploaded_at", "dataset_id").select(order.alias("place"), "name", "row_count")


def _catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.system_counts(read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "events"),
                           D.with_active_flag(spark, _catalog(spark, sf_dir)))


def _exported_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report exported as CSV rows and JSON tables, read back."""
    sales = load_sales(spark, sf_dir)
    root = f"{derived_table_path(spark, 'exports', materialize_sales(spark, sf_dir))}/{new_id()}"
    rows = spark.read.option("header", True).csv(X.export_report(sales, REPORT_FILTER, "csv", f"{root}/csv")["rows"])
    tables = X.export_report(sales, REPORT_FILTER, "pdf", f"{root}/pdf")
    kpis = spark.read.schema("position int, metric string, value string").json(tables["kpis"])
    tops = spark.read.schema("product string, revenue_text string, revenue double").json(tables["top_products"])
    lines = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quantity").cast("double")).cast("bigint").alias("q"))
    return (kpis.select(F.lit("kpis").alias("part"), F.col("metric").alias("key"), "value")
            .unionByName(tops.select(F.lit("top_products").alias("part"), F.col("product").alias("key"), F.col("revenue_text").alias("value")))
            .unionByName(lines.select(F.lit("rows").alias("part"), F.col("region").alias("key"), F.concat_ws(" / ", "n", "q").alias("value"))))


QUERIES: dict[str, Query] = {
    # J5 and the breakdowns
    "sales_view": _on_sales(_rows),
    "monthly_revenue": _on_sales(B.monthly_revenue),
    "revenue_by_category": _on_sales(B.revenue_by_category),
    "revenue_by_region": _on_sales(B.revenue_by_region),
    "payment_method_counts": _on_sales(B.payment_method_counts),
    "order_status_counts": _on_sales(B.order_status_counts),
    "top_products": _on_sales(B.top_products),
    "daily_revenue": _on_sales(B.daily_revenue),
    "region_category_matrix": _on_sales(B.region_category_long),
    "top_items": _on_sales(B.brief_top_items),
    "preferred_payment": _on_sales(B.preferred_payment),
    "best_product": _on_sales(B.best_product),
    "leading_category": _on_sales(B.leading_category),
    "leading_region": _on_sales(B.leading_region),
    "region_cancellation": _on_sales(B.region_cancellation),
    "monthly_history": _on_sales(B.monthly_history),
    "filter_options": _on_sales(B.filter_options),
    # KPIs and filters
    "kpis": _on_sales(kpi_card),
    "kpis_approx": lambda spark, sf_dir: estimates(spark, sales_sketches(spark, sf_dir), "1996-01", "1999-06"),
    "kpis_filtered": _on_sales(lambda df: kpi_card(apply_filters(df, E1_FILTER))),
    "filtered_orders": _on_sales(lambda df: _rows(apply_filters(df, F10_FILTER))),
    "filtered_orders_long_list": _on_sales(lambda df: _rows(apply_filters(df, LONG_FILTER))),
    "filtered_orders_literal": _on_sales(lambda df: _rows(apply_filters(df, LITERAL_FILTER))),
    "date_presets": _on_sales(date_presets),
    # forecast
    "forecast": _on_sales(P.forecast),
    "forecast_series": _on_sales(P.forecast_series),
    "trend_fit": _on_sales(_trend_fit),
    "forecast_confidence": _on_sales(P.forecast_confidence),
    "forecast_by_product": _on_sales(lambda df: forecast_by(df, "product")),
    "forecast_by_region": _on_sales(lambda df: forecast_by(df, "region")),
    # insights
    "insights": _on_sales(I.insights),
    "kpi_brief": _on_sales(I.kpi_brief),
    "insights_no_data": _on_sales(lambda df: I.insights(apply_filters(df, NO_ROWS_FILTER))),
    "insights_risks": _on_sales(lambda df: I.insights(apply_filters(df, RISK_FILTER))),
    "report_insights": _on_sales(lambda df: E.report_insights(df, REPORT_FILTER)),
    # listings, bundles, exports
    "orders_api": _on_sales(lambda df: _rows(E.orders_endpoint(df, "widget", ["ECONOMY", "SMALL"]))),
    "orders_page": _on_sales(lambda df: _rows(L.page(apply_filters(df, E1_FILTER), 3))),
    "orders_last_page": _last_page,
    "preview_rows": _preview_rows,
    "dashboard_rollup": _on_sales(E.dashboard_rollup),
    "dashboard": lambda spark, sf_dir: stored_dashboard(spark, sales_rollups(spark, sf_dir)),
    "dashboard_1997": lambda spark, sf_dir: stored_dashboard(spark, sales_rollups(spark, sf_dir), "1997-01", "1997-12"),
    "charts_bundle": _on_sales(lambda df: E.charts_endpoint(df, E1_FILTER)),
    "workbook_summary": _on_sales(lambda df: X.workbook_summary(kpi_card(df))),
    "report_kpi_table": _on_sales(lambda df: X.report_kpi_table(kpi_card(df))),
    "report_top_products": _on_sales(X.report_top_products),
    # text preview, activity
    "document_previews": _document_previews,
    "recent_activity": _recent_activity,
    "user_activity_counts": _activity_counts,
    # profiling and cleaning (dirty variant)
    "data_profile": _on_dirty(C.quality_report),
    "missing_by_column": _on_dirty(C.missing_by_column),
    "data_warnings": _on_dirty(C.warnings_table),
    "cleaned_sales": _on_dirty(C.clean_data),
    "cleaned_sales_dayfirst": _on_dirty(C.clean_data, DAY_FIRST),
    "data_profile_dayfirst": _on_dirty(C.quality_report, DAY_FIRST),
    "csv_profile": _csv_profile,
    "required_columns": lambda spark, sf_dir: C.validation_table(dirty_sales(spark, sf_dir).drop("Region")),
    # catalog, exports
    "active_sales_kpis": _active_kpis,
    "dataset_catalog": _dataset_catalog,
    "newest_datasets": _newest_datasets,
    "catalog_counts": _catalog_counts,
    "exported_report": _exported_report,
    "order_status_json": _on_sales(lambda df: as_json(B.order_status_counts(df))),
}
