"""The whole dashboard (E6) from the partial sums per month, as one long table.

``(panel, position, key, key2, value, text)``: the KPI card, every chart, the filter
options, date presets, insights, the forecast and its confidence.  No raw row is read;
the operators are those of the direct forms, fed with sums in place of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.breakdowns import region_category_long
from ..operators.filters import date_presets
from ..operators.forecast import forecast, forecast_confidence
from ..operators.insights import insights_from
from ..operators.kpis import KPI_COLUMNS, card_from_levels
from ..sources import rollups

PANEL_SCHEMA = "panel string, position int, key string, key2 string, value double, text string"
CARD_LEVELS = {"all": None, "month": "k_month", "region": "k_region", "category": "k_category", "customer": "k_customer", "order": "k_order",
               "product": "k_product", "payment_method": "k_payment"}
TEXT_METRICS = ("top_region", "top_category", "best_sales_month", "worst_sales_month")


class StoredLevels:
    """The groups that the KPI card folds, merged from partial sums."""

    def __init__(self, sums: DataFrame):
        self.cols = {"region", "category", "customer_name", "order_id", "order_date", "product", "payment_method", "order_status",
                     "quantity", "revenue"}
        self.has_rev = True
        self.keys = {k: F.col(k) for k in CARD_LEVELS.values() if k}
        rows = sums.withColumn("level", F.when((F.col("level") == "all") & (F.col("month") != rollups.UNDATED), F.array(F.lit("all"), F.lit("month")))
                               .otherwise(F.array("level"))).withColumn("level", F.explode("level"))
        key = F.when(F.col("level") == "month", F.concat("month", F.lit("-01"))).when(F.col("level") == "all", None).otherwise(F.col("k1"))
        merged = rows.groupBy("level", key.alias("key")).agg(
            F.sum("revenue").alias("rev"), F.sum("quantity").alias("qty"), F.sum("n").alias("n"),
            F.sum("n_cancel").alias("n_cancel"), F.sum("n_return").alias("n_return"))
        named = {k: F.when(F.col("level") == level, F.col("key").cast("date") if level == "month" else F.col("key")) for level, k in CARD_LEVELS.items() if k}
        self.grouped = merged.withColumns(named).withColumns({"cost": F.lit(None).cast("double"), "qty_mean": F.col("qty") / F.col("n")})

    def level(self, name: str | None, keep_null: bool = False) -> Column:
        of = {k: level for level, k in CARD_LEVELS.items()}
        cond = F.col("level") == of[name]
        return cond & F.col("key").isNotNull() if name is not None and not keep_null else cond


def _panel(df: DataFrame, panel: str, position=None, key=None, key2=None, value=None, text=None) -> DataFrame:
    none = F.lit(None)
    pick = lambda c, kind: (F.col(c) if isinstance(c, str) else none if c is None else c).cast(kind)
    return df.select(F.lit(panel).alias("panel"), pick(position, "int").alias("position"), pick(key, "string").alias("key"),
                     pick(key2, "string").alias("key2"), pick(value, "double").alias("value"), pick(text, "string").alias("text"))


def stored_dashboard(spark: SparkSession, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every panel over all months, or those from ``start`` to ``end`` (filter options and presets: always all)."""
    card_sums = rollups.read(spark, root, ["all", "region", "category", "customer", "order", "product", "payment_method"], start, end)
    row = card_from_levels(StoredLevels(card_sums)).cache()  # one row: the card and what the insights quote
    small = rollups.read(spark, root, ["all", "day", "category", "region", "payment_method", "order_status", "region_category", "product"], start, end)
    sums = small.groupBy("level", "k1", "k2").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.sum("n").alias("n"))
    of = lambda level: sums.where((F.col("level") == level) & F.col("k1").isNotNull())
    revenue = F.coalesce("revenue", F.lit(0)).cast("double")
    chart = lambda level, name, value: _panel(of(level), name, key="k1", value=value)
    months = small.where((F.col("level") == "all") & (F.col("month") != rollups.UNDATED)).groupBy("month").agg(F.sum("revenue").alias("revenue"))

    # The forecast's own operator over sums: category sums carry all revenue, product sums all quantities.
    dated = small.where(F.col("month") != rollups.UNDATED)
    date, text, number = F.concat("month", F.lit("-01")).cast("date").alias("order_date"), F.lit(None).cast("string"), F.lit(None).cast("double")
    series = dated.where("level = 'category'").select(date, F.col("k1").alias("category"), "revenue", text.alias("product"), number.alias("quantity")).unionByName(
        dated.where("level = 'product'").select(date, text.alias("category"), F.lit(None).cast("decimal(38,4)").alias("revenue"),
                                                F.col("k1").alias("product"), "quantity"))
    ahead, trust = forecast(series), forecast_confidence(series)

    metrics = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("key"),
                                 (F.lit(None) if c in TEXT_METRICS else F.col(c)).cast("double").alias("value"),
                                 (F.col(c) if c in TEXT_METRICS else F.lit(None)).cast("string").alias("text")) for i, c in enumerate(KPI_COLUMNS)])
    rank = F.row_number().over(Window.orderBy(F.desc("value"), F.asc("k1")))  # over ten rows
    best = of("product").select("k1", revenue.alias("value")).orderBy(F.desc("value"), F.asc("k1")).limit(10).withColumn("position", rank)
    heat = region_category_long(sums.where("level = 'region_category'").select(F.col("k1").alias("region"), F.col("k2").alias("category"), "revenue"))
    # What the filters offer does not depend on what they are set to.
    offered = ["category", "region", "payment_method", "order_status"]
    ever = rollups.read(spark, root, ["day", *offered]).where(F.col("k1").isNotNull()).select("level", "k1").distinct()
    options = ever.where(F.col("level").isin(offered))
    days = ever.where("level = 'day'").select(F.col("k1").cast("date").alias("order_date"))
    panels = [
        _panel(row.select(F.inline(metrics)), "kpis", "position", "key", None, "value", "text"),
        _panel(months, "monthly_trend", key="month", value=revenue),
        chart("day", "daily_trend", revenue), chart("category", "category_rev", revenue), chart("region", "region_rev", revenue),
        chart("payment_method", "payment_methods", "n"), chart("order_status", "order_status", "n"),
        _panel(best, "top_products", "position", "k1", None, "value"),
        _panel(heat, "heatmap", key="region", key2="category", value="revenue"),
        _panel(options, "filter_options", key="level", key2="k1"),
        _panel(date_presets(days), "date_presets", key="date_start", key2="date_end", text="label"),
        _panel(insights_from(row), "insights", "position", "category", "severity", None, "text"),
        _panel(ahead, "forecast_revenue", key="period", value="predicted_revenue"),
        _panel(ahead, "forecast_product", key="period", value="predicted_product_demand", text="top_product"),
        _panel(ahead, "forecast_category", key="period", value="predicted_category_revenue", text="top_category"),
        _panel(trust, "forecast_meta", key="confidence", key2=F.col("has_enough_history").cast("string"), value="month_count", text="note"),
    ]
    out = panels[0]
    for panel in panels[1:]:
        out = out.unionByName(panel)
    return out
