"""Rule-based insights (I0-I15) and the KPI brief text (I16).

Input is one row: the KPI card plus the five leaders the rules quote
(leading category, best product, leading region, preferred payment, worst
region by cancellation), all folded from ONE grouping-sets aggregate.  Each rule is a
``when(condition, struct)``; the fired ones are exploded into rows
(category, position, severity, text).  No raw rows reach the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..functions.text import fixed, grouped_int, money
from ..schema import NOT_AVAILABLE
from .breakdowns import brief_top_items
from .kpis import kpi_card_with_leaders

# --- fixed values: category names, severities and sentence templates -------
# Placeholders: {name:,.2f} money, {name:,} grouped integer, {name:.1f} /
# {name:.2f} fixed decimals, {name} plain text.

CATEGORIES = ("Revenue Insights", "Product Insights", "Customer Insights", "Risk Alerts")

TEMPLATES = {
    "I0": "No data available to generate insights.",
    "I1": "Total revenue across all transactions is Rs {total_revenue:,.2f} with {total_orders:,} orders processed.",
    "I2": "The average order value is Rs {aov:,.2f}.",
    "I3": "Monthly revenue grew by {growth:.1f}% compared to the previous month.",
    "I4": "Monthly revenue declined by {decline:.1f}% compared to the previous month. "
          "Immediate attention is recommended.",
    "I5": "Estimated profit margin is {margin:.1f}% with gross profit of Rs {gross_profit:,.2f}.",
    "I6": "The {lead_category} category leads revenue with Rs {lead_category_revenue:,.2f} ({lead_category_pct:.1f}% of total).",
    "I7": "'{best_product}' is the best-selling product, generating Rs {best_product_revenue:,.2f}.",
    "I8": "Customers are purchasing an average of {basket:.1f} items per order.",
    "I9": "The {lead_region} region is the strongest market, contributing Rs {lead_region_revenue:,.2f}.",
    "I10": "Customer retention is strong at {retention:.1f}%. Loyalty programs are highly effective.",
    "I11": "Only {retention:.1f}% of customers are returning. Consider post-purchase engagement to boost loyalty.",
    "I12": "The preferred payment method is {payment} ({payment_count:,} transactions).",
    "I13c": "High Cancellation Rate: {cancel:.1f}% of orders are cancelled. Immediate investigation required.",
    "I13w": "Cancellation rate is {cancel:.1f}%. Consider reviewing inventory availability and checkout UX.",
    "I14c": "High Return Rate: {returns:.1f}% of items are being returned. Quality control review is strongly advised.",
    "I14w": "Return rate is {returns:.1f}%. Ensure product descriptions match the physical items.",
    "I15": "{worst_region} region is experiencing an abnormal cancellation rate of {worst_rate:.1f}%.",
}

BRIEF_LINES = (
    "Revenue: Rs {total_revenue:,.2f}",
    "Orders: {total_orders}",
    "Average Order Value: Rs {aov:,.2f}",
    "Cancellation Rate: {cancellation_rate:.2f}%",
    "Return Rate: {return_rate:.2f}%",
    "Returning Customer Rate: {returning_customer_rate:.2f}%",
    "Top Region: {top_region}",
    "Top Category: {top_category}",
)
BRIEF_SECTIONS = (
    ("Top Products:", "product", "revenue"),
    ("Top Categories:", "category", "revenue"),
    ("Region Sales:", "region", "revenue"),
    ("Payment Methods:", "payment_method", None),
    ("Order Status Summary:", "order_status", None),
)
BRIEF_VALUE_LINE = "- {label}: Rs {value:,.2f}"
BRIEF_COUNT_LINE = "- {label}: {value}"
BRIEF_MISSING = "- N/A"

# Thresholds of the rules (percent).
CANCEL_CRITICAL, CANCEL_WARNING = 15, 8
RETURN_CRITICAL, RETURN_WARNING = 10, 5
RETENTION_STRONG = 30
REGION_CANCEL_CRITICAL = 15

_FIELD = re.compile(r"\{(\w+)(?::([^}]*))?\}")


def render(template: str, values: dict[str, Column]) -> Column:
    """Template -> string Column, formatting like Python's format spec."""
    parts: list[Column] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        value, spec = values[m.group(1)], m.group(2) or ""
        if spec == ",.2f":
            parts.append(money(value))
        elif spec == ",":
            parts.append(grouped_int(value))
        elif spec in (".1f", ".2f"):
            parts.append(fixed(value, int(spec[1])))
        else:
            parts.append(value.cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def insight_inputs(df: DataFrame) -> DataFrame:
    """One row: the KPI card plus the five leaders the rules quote, all from
    one grouping-sets aggregate (one scan)."""
    return kpi_card_with_leaders(df)


def insights(df: DataFrame) -> DataFrame:
    """I0-I15 as rows (category, position, severity, text) in display order."""
    return insights_from(insight_inputs(df))


def insights_from(row: DataFrame) -> DataFrame:
    """I0-I15 from an ``insight_inputs`` row (lets a caller share that row)."""
    cols = set(row.columns)
    v = {
        "total_revenue": F.col("total_revenue"), "total_orders": F.col("total_orders"),
        "aov": F.col("aov"), "growth": F.col("monthly_growth"), "decline": F.abs(F.col("monthly_growth")),
        "margin": F.col("profit_margin"), "gross_profit": F.col("gross_profit"),
        "basket": F.col("avg_basket_size"), "retention": F.col("returning_customer_rate"),
        "cancel": F.col("cancellation_rate"), "returns": F.col("return_rate"),
    }
    rules: list[tuple[int, int, str, Column, str, str]] = []  # (cat, order, rule, cond, severity, template)

    def add(cat: int, order: int, rule: str, cond: Column, severity: str, template: str) -> None:
        rules.append((cat, order, rule, cond, severity, template))

    add(0, 1, "I1", F.col("total_revenue") > 0, "good", "I1")
    add(0, 2, "I2", F.col("aov") > 0, "good", "I2")
    add(0, 3, "I3", F.col("monthly_growth") > 0, "good", "I3")
    add(3, 1, "I4", F.col("monthly_growth") < 0, "critical", "I4")
    add(0, 4, "I5", F.col("profit_margin") > 0, "good", "I5")
    if "lead_category" in cols:
        lc = F.col("lead_category")
        v.update(lead_category=lc["k"], lead_category_revenue=lc["v"],
                 lead_category_pct=F.when(F.col("total_revenue") > 0, rate(lc["v"], F.col("total_revenue")))
                 .otherwise(0.0))
        add(1, 1, "I6", (F.col("top_category") != NOT_AVAILABLE) & lc.isNotNull(), "good", "I6")
    if "best_product" in cols:
        bp = F.col("best_product")
        v.update(best_product=bp["k"], best_product_revenue=bp["v"])
        add(1, 2, "I7", bp.isNotNull(), "good", "I7")
    add(1, 3, "I8", F.col("avg_basket_size") > 0, "good", "I8")
    if "lead_region" in cols:
        lr = F.col("lead_region")
        v.update(lead_region=lr["k"], lead_region_revenue=lr["v"])
        add(2, 1, "I9", (F.col("top_region") != NOT_AVAILABLE) & lr.isNotNull(), "good", "I9")
    retention = F.col("returning_customer_rate")
    add(2, 2, "I10", retention >= RETENTION_STRONG, "good", "I10")
    add(2, 2, "I11", (retention > 0) & (retention < RETENTION_STRONG), "warning", "I11")
    if "payment" in cols:
        pm = F.col("payment")
        v.update(payment=pm["k"], payment_count=pm["v"])
        add(2, 3, "I12", pm.isNotNull(), "good", "I12")
    cancel, returns = F.col("cancellation_rate"), F.col("return_rate")
    add(3, 2, "I13", cancel > CANCEL_CRITICAL, "critical", "I13c")
    add(3, 2, "I13", (cancel > CANCEL_WARNING) & (cancel <= CANCEL_CRITICAL), "warning", "I13w")
    add(3, 3, "I14", returns > RETURN_CRITICAL, "critical", "I14c")
    add(3, 3, "I14", (returns > RETURN_WARNING) & (returns <= RETURN_CRITICAL), "warning", "I14w")
    if "worst_region" in cols:
        wr = F.col("worst_region")
        v.update(worst_region=wr["k"], worst_rate=wr["v"])
        add(3, 4, "I15", wr.isNotNull() & (wr["v"] > REGION_CANCEL_CRITICAL), "critical", "I15")

    def item(cat: int, order: int, rule: str, severity: str, text: Column) -> Column:
        return F.struct(F.lit(cat).alias("cat"), F.lit(order).alias("ord"), F.lit(rule).alias("rule"),
                        F.lit(CATEGORIES[cat]).alias("category"), F.lit(severity).alias("severity"),
                        text.alias("text"))

    fired = [F.when(cond, item(cat, order, rule, sev, render(TEMPLATES[tpl], v)))
             for cat, order, rule, cond, sev, tpl in rules]
    no_data = item(3, 0, "I0", "critical", F.lit(TEMPLATES["I0"]))
    chosen = F.when(F.col("non_empty"), F.filter(F.array(*fired), lambda x: x.isNotNull())) \
        .otherwise(F.array(no_data))
    rows = row.select(F.inline(chosen))
    w = Window.partitionBy("cat").orderBy("ord")  # at most sixteen rows in all
    return (rows.select("cat", "ord", "category", (F.row_number().over(w) - 1).cast("int").alias("position"),
                        "severity", "text")
                .orderBy("cat", "ord").drop("cat", "ord"))


# --- I16: KPI brief --------------------------------------------------------


def _top_lines(df: DataFrame, k: int = 5) -> Column:
    """Scalar subquery: ``(dimension, rank, line)`` of all five top-k lists, at most 5 k entries, from one scan."""
    summed = [key for _, key, value in BRIEF_SECTIONS if value is not None and value in df.columns]
    values = {"label": F.col("label"), "value": F.col("value")}
    counts = {"label": F.col("label"), "value": F.col("value").cast("bigint")}
    line = F.when(F.col("dimension").isin(summed), render(BRIEF_VALUE_LINE, values)).otherwise(render(BRIEF_COUNT_LINE, counts))
    return brief_top_items(df, k).agg(F.sort_array(F.collect_list(F.struct("dimension", "rank", line.alias("line"))))).scalar()


def _of(dimension: str):
    return lambda x: x["dimension"] == dimension


def kpi_brief(df: DataFrame) -> DataFrame:
    """I16: the KPI summary text (8 metric lines, then five top-5 sections).

    A section keyed by a missing column reads ``- N/A``; a revenue section
    without a revenue column lists row counts instead.
    """
    card = kpi_card_with_leaders(df, leaders=False)
    values = {c: F.col(c) for c in card.columns}
    card = card.withColumn("__top", _top_lines(df))
    lines: list[Column] = [render(t, values) for t in BRIEF_LINES]
    for title, key, _ in BRIEF_SECTIONS:
        if key not in df.columns:
            body = F.lit(BRIEF_MISSING)
        else:
            own = F.filter("__top", _of(key))
            # no groups: the section has no lines (concat_ws skips a null)
            text = F.nullif(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit(""))
            body = F.when(F.col("non_empty"), text).otherwise(F.lit(BRIEF_MISSING))
        lines += [F.lit(""), F.lit(title), body]
    return card.select(F.concat_ws("\n", *lines).alias("brief"))
