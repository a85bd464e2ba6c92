"""Export tables and the export endpoint.

Documents (workbook styling, PDF layout) are not produced; these are the
tables they are built from, as DataFrames, written by distributed sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_like_python
from ..functions.text import fixed, grouped_int, money
from ..operators.breakdowns import top_products
from ..operators.filters import SalesFilter, apply_filters
from ..operators.kpis import kpi_card
from ..sources.sinks import write_csv, write_json

# --- fixed values: metric labels of the two report tables -----------------
WORKBOOK_METRICS = (
    "Total Revenue (Rs)", "Total Orders", "Average Order Value (Rs)", "Top Region",
    "Top Category", "Cancellation Rate (%)", "Returning Customer Rate (%)",
)
REPORT_METRICS = (
    "Total Revenue", "Total Orders", "Average Order Value (AOV)", "Top Performing Region",
    "Top Performing Category", "Order Cancellation Rate", "Returning Customer Rate",
)


def _rows(card: DataFrame, entries: list[tuple[int, str, Column, Column]], names: tuple[str, str, str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(label).alias(names[0]),
                             num.cast("double").alias(names[1]), text.cast("string").alias(names[2]))
                    for i, label, num, text in entries])
    return card.select(F.inline(arr))


def workbook_summary(kpis: DataFrame) -> DataFrame:
    """S7 summary sheet: (position, metric, value_number, value_text), 2 dp."""
    k = lambda c: F.col(c)
    none = F.lit(None)
    m = WORKBOOK_METRICS
    entries = [
        (0, m[0], round_like_python(k("total_revenue"), 2), none), (1, m[1], k("total_orders"), none),
        (2, m[2], round_like_python(k("aov"), 2), none), (3, m[3], none, k("top_region")),
        (4, m[4], none, k("top_category")), (5, m[5], round_like_python(k("cancellation_rate"), 2), none),
        (6, m[6], round_like_python(k("returning_customer_rate"), 2), none),
    ]
    return _rows(kpis, entries, ("metric", "value_number", "value_text"))


def report_kpi_table(kpis: DataFrame) -> DataFrame:
    """S8 KPI table: (position, metric, value) with display formatting."""
    k = lambda c: F.col(c)
    m = REPORT_METRICS
    pct = lambda c: F.concat(fixed(k(c), 2), F.lit("%"))
    entries = [
        (0, m[0], F.lit(None), F.concat(F.lit("Rs "), money(k("total_revenue")))),
        (1, m[1], F.lit(None), grouped_int(k("total_orders"))),
        (2, m[2], F.lit(None), F.concat(F.lit("Rs "), money(k("aov")))),
        (3, m[3], F.lit(None), k("top_region")),
        (4, m[4], F.lit(None), k("top_category")),
        (5, m[5], F.lit(None), pct("cancellation_rate")),
        (6, m[6], F.lit(None), pct("returning_customer_rate")),
    ]
    return _rows(kpis, entries, ("metric", "unused", "value")).drop("unused")


def report_top_products(df: DataFrame, k: int = 10) -> DataFrame:
    """S8 product table: top-10 products with formatted revenue."""
    return top_products(df, k).select(
        F.col("product"), F.concat(F.lit("Rs "), money(F.col("revenue"))).alias("revenue_text"), "revenue")


class NothingToExport(ValueError):
    """The table has no rows."""


def export_report(df: DataFrame, spec: SalesFilter | None, fmt: str, out_dir: str) -> dict[str, str]:
    """Filter -> KPIs -> the chosen sink; returns the written paths.

    A table without rows is refused, and so is an unknown format, before anything is written.
    """
    if fmt not in ("csv", "excel", "pdf"):
        raise ValueError(f"invalid export format: {fmt!r}")
    if df.isEmpty():
        raise NothingToExport("No data to export")
    rows = apply_filters(df, spec)
    rows = rows.drop("order_month") if "order_month" in rows.columns else rows
    card = kpi_card(rows)
    out = out_dir.rstrip("/")
    if fmt == "csv":
        return {"rows": write_csv(rows, f"{out}/rows")}
    if fmt == "excel":
        return {"rows": write_csv(rows, f"{out}/sales_data"),
                "summary": write_csv(workbook_summary(card), f"{out}/summary")}
    return {"kpis": write_json(report_kpi_table(card), f"{out}/kpis"),
            "top_products": write_json(report_top_products(rows), f"{out}/top_products")}
