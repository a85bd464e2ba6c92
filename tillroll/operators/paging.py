"""Row listings: first n rows (L1), pages (L2), preview (L3).

The original lists rows in file order; a distributed table has none, so rows are
ordered by (date, order id, product, then every other column) -- a total order up to
identical rows, which are indistinguishable.

**Pages by a day index.**  Rows per day, summed up in day order, tell on which days a
page lies and how many rows of the first of them come before it.  Only those days
are read (a predicate on the date, and on the month folder where there is one), and
only they are sorted.  The index has a row per day of the calendar, whatever the
number of rows.  A filter is counted per day in one scan of the columns it names; the
unfiltered listings of the stored table use an index that is written with it.

**Inside a day** counts of order ids in ranges narrow the rows down the same way while
more than ``LEVEL_ROWS`` come before the page, so no task holds a long prefix and every
offset is a 64-bit number.  Ids that are not numbers cannot be cut into ranges; there
a day's prefix is sorted whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType

from ..functions.dates import as_date
from ..schema import date_column

PAGE_SIZE = 10
ORDERS_LIMIT = 50
PREVIEW_ROWS = 15
# Rows of a day in front of a page that are still sorted away in one go.
LEVEL_ROWS = 1 << 20
# Ranges that order ids are cut into at a time.
RANGES = 1 << 10


def stable_order(df: DataFrame) -> list[Column]:
    first = [c for c in (date_column(df), "order_id", "product") if c and c in df.columns]
    rest = [c for c in df.columns if c not in first]
    return [F.col(f"`{c}`").asc_nulls_first() for c in first + rest]


def first_rows(df: DataFrame, n: int = ORDERS_LIMIT) -> DataFrame:
    """L1: the first ``n`` rows in the stable order."""
    return df.orderBy(*stable_order(df)).limit(n)


def page_number(requested, total_rows: int, size: int = PAGE_SIZE) -> int:
    """Paginator rule: non-integer -> 1; below 1 or past the end -> last page."""
    pages = max(1, math.ceil(total_rows / size))
    try:
        number = int(requested)
    except (TypeError, ValueError):
        return 1
    if number < 1 or number > pages:
        return pages
    return number


def day_index(df: DataFrame) -> DataFrame:
    """Rows per day, ``(day, n)``; rows without a date have a null day.  Two columns of one scan at most."""
    name = date_column(df)
    day = as_date(df, name) if name else F.lit(None).cast("date")
    return df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _on_days(df: DataFrame, days: list) -> DataFrame:
    """The rows of some days, by a predicate that reaches the scan."""
    name = date_column(df)
    if name is None:
        return df
    is_date = isinstance(df.schema[name].dataType, DateType)
    value = F.col(name) if is_date else as_date(df, name)
    dated = [d for d in days if d is not None]
    parts = []
    if dated:
        inside = value.between(F.lit(min(dated)), F.lit(max(dated)))
        if is_date and name == "order_date" and "order_month" in df.columns:
            inside = inside & F.col("order_month").between(min(dated).strftime("%Y-%m"), max(dated).strftime("%Y-%m"))
        parts.append(inside)
    if len(dated) < len(days):
        parts.append(value.isNull())
    return df.where(parts[0] if len(parts) == 1 else parts[0] | parts[1])


def _narrowed(df: DataFrame, offset: int, n: int) -> tuple[DataFrame, int]:
    """Rows of one day from which a long prefix is cut off by ranges of order ids."""
    if "order_id" not in df.columns or not isinstance(df.schema["order_id"].dataType, IntegralType):
        return df, offset
    rows = df
    while offset > LEVEL_ROWS:
        low, high, nulls = rows.agg(F.min("order_id"), F.max("order_id"), F.count_if(F.col("order_id").isNull())).first()
        if low is None or offset < nulls or low == high:
            break
        width = (high - low) // RANGES + 1
        bucket = F.floor((F.col("order_id").cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("bigint")
        counts = rows.where(F.col("order_id").isNotNull()).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
        before, first = nulls, None
        for b, count in counts:  # at most RANGES rows
            if before + count > offset:
                first = b
                break
            before += count
        if first is None:
            break
        after, left = first, offset + n - before
        for b, count in counts:
            if b >= first and left > 0:
                after, left = b, left - count
        start, end = low + first * width, min(high, low + (after + 1) * width - 1)
        rows, offset = rows.where(F.col("order_id").between(F.lit(start), F.lit(end))), offset - before
        if width == 1 or (start, end) == (low, high):
            break
    return rows, offset


def rows_at(df: DataFrame, offset: int, n: int, index: DataFrame | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` of the stable order, read from their days alone.

    ``index`` is a day index of exactly these rows, if the caller has one.
    """
    counts = index if index is not None else day_index(df)
    # One row per calendar day: the running sum is small whatever the table.
    upto = F.sum("n").over(Window.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = (counts.where("n > 0").withColumn("upto", upto)
            .where((F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + n))
            .orderBy("upto").collect())  # at most n days
    if not held:
        return df.limit(0)
    days = [r["day"] for r in held]
    inside = offset - (held[0]["upto"] - held[0]["n"])
    rows = _on_days(df, days)
    if len(days) == 1:
        rows, inside = _narrowed(rows, inside, n)
    return rows.orderBy(*stable_order(df)).offset(inside).limit(n)


def page(df: DataFrame, requested=1, size: int = PAGE_SIZE, index: DataFrame | None = None) -> DataFrame:
    """L2: one page of rows; a number below 1 or past the end is the last page."""
    counts = index if index is not None else day_index(df)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number = page_number(requested, total, size)
    return rows_at(df, (number - 1) * size, size, index)


def preview(df: DataFrame, n: int = PREVIEW_ROWS, index: DataFrame | None = None) -> DataFrame:
    """L3: the first rows shown on the dataset page."""
    return rows_at(df, 0, n, index)
