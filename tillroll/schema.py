"""Canonical sales schema and the fixed values the engine must agree on.

Everything operates on one denormalised sales table.  Column presence is
checked on ``df.columns`` while the plan is built, so a missing column never
costs a job: the operator returns its documented default instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the behaviour being reproduced) -------------

# Required columns, in this order, for a dataset to be accepted.
REQUIRED_COLUMNS = (
    "order_id", "customer_name", "product", "category", "region",
    "quantity", "revenue", "payment_method", "order_status", "order_date",
)

# Raw-name synonyms applied after name normalisation.
COLUMN_SYNONYMS = {
    "product_category": "category",
    "product_name": "product",
    "total_sales": "revenue",
    "sales": "revenue",
}

# Column names (trimmed, lowered, spaces to "_") expected to hold numbers.
NUMERIC_EXPECTED = ("revenue", "quantity", "price", "cost", "total_sales", "sales")

# Column names (trimmed, lowered) whose negative values are counted.
REVENUE_NAMES = ("revenue", "total_sales", "sales")

# Text tokens a CSV reader treats as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Fill value for missing text after cleaning.
UNKNOWN = "Unknown"

# Placeholder for a missing dimension in the KPI card.
NOT_AVAILABLE = "N/A"

# Share of revenue taken as gross profit when there is no cost column.
DEFAULT_MARGIN = 0.30

# Status values compared case-insensitively.
STATUS_CANCELLED = "cancelled"
STATUS_RETURNED = "returned"

# Month label format (period "M").
MONTH_FORMAT = "yyyy-MM"

# --- column finders -------------------------------------------------------


def date_column(df: DataFrame) -> str | None:
    """First column whose name contains ``date`` (case-sensitive, column order)."""
    for name in df.columns:
        if "date" in name:
            return name
    return None


def date_columns_ci(df: DataFrame) -> list[str]:
    """All columns whose lowered name contains ``date``."""
    return [c for c in df.columns if "date" in c.lower()]


def has(df: DataFrame, *names: str) -> bool:
    cols = set(df.columns)
    return all(n in cols for n in names)


def col(name: str) -> Column:
    """Column by exact name (quoted, so dots or spaces in raw headers are literal)."""
    return F.col("`" + name.replace("`", "``") + "`")
