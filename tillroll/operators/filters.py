"""Dashboard filters (F1-F13) compiled into one Catalyst predicate.

A filter applies only when its column exists and its value is non-empty;
all applied filters are conjunctive.  The whole spec becomes one ``where``,
so Catalyst pushes the simple comparisons into the parquet scan.  When the
input carries the ``order_month`` partition column (the stored sales
table), date bounds also produce month predicates that prune whole
partition folders.

A value list of more than ``LONG_LIST`` entries does not go into the plan: its least
and greatest value bound the scan, and a semi join with the list decides exactly.
The driver holds the list, so its size is known: up to ``BROADCAST_BYTES`` it is
broadcast, beyond that both sides are shuffled on the column.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from typing import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from ..functions.dates import as_date, parse_or_null
from ..schema import date_column, date_columns_ci

LONG_LIST = 10_000
BROADCAST_BYTES = 32 << 20
LIST_COLUMNS = ("category", "region", "payment_method", "order_status")


@dataclass(frozen=True)
class SalesFilter:
    date_start: str | None = None
    date_end: str | None = None
    category: Sequence[str] | str | None = None
    region: Sequence[str] | str | None = None
    payment_method: Sequence[str] | str | None = None
    order_status: Sequence[str] | str | None = None
    revenue_min: float | str | None = None
    revenue_max: float | str | None = None
    product_search: str | None = None
    # the search is a pattern, as in the original, unless it is asked to be plain text
    product_literal: bool = False

    @classmethod
    def from_params(cls, params: dict) -> "SalesFilter":
        """Build from request-style parameters (lists or scalars, '' = unset)."""
        known = {f for f in cls.__dataclass_fields__}
        return cls(**{k: v for k, v in params.items() if k in known})


def _as_list(value) -> list:
    if value is None or value == "" or (not isinstance(value, str) and len(value) == 0):
        return []
    return [value] if isinstance(value, str) else list(value)


# Layouts of a bound that is not ISO, tried in order: month first where both would do.
BOUND_LAYOUTS = ("%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y", "%Y%m%d")


def _day(text: str) -> dt.datetime:
    """A bound from date or date-time text; anything else is an error, as in the original."""
    text = str(text).strip()
    try:
        return dt.datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        pass
    for layout in BOUND_LAYOUTS:
        for suffix in ("", " %H:%M", " %H:%M:%S"):
            try:
                return dt.datetime.strptime(text, layout + suffix)
            except ValueError:
                continue
    raise ValueError(f"not a date: {text!r}")


def _wall_clock(value: dt.datetime) -> Column:
    """A literal that no zone moves: the text itself, read as TIMESTAMP_NTZ."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _decimal_bound(df: DataFrame, value: float, lower: bool) -> Column:
    """Literal for ``revenue >= / <= value`` in the column's own type.

    For a DECIMAL column the bound is rounded toward the inside (ceiling for
    a minimum, floor for a maximum) at the column's scale, which keeps the
    comparison exact and lets it be pushed into the scan without a cast on
    the column.
    """
    dtype = df.schema["revenue"].dataType
    if isinstance(dtype, DecimalType) and math.isfinite(value):
        q = Decimal(1).scaleb(-dtype.scale)
        bound = Decimal(repr(value)).quantize(q, rounding=ROUND_CEILING if lower else ROUND_FLOOR)
        if len(bound.as_tuple().digits) - max(0, -bound.as_tuple().exponent) <= dtype.precision - dtype.scale:
            return F.lit(bound).cast(dtype)
    return F.lit(float(value))


def _date_bounds(df: DataFrame, name: str, spec: SalesFilter, prune_months: bool) -> list[Column]:
    """F1 / F2: ``date >= start`` and ``date <= end`` (end at midnight).

    A DATE column is compared with DATE literals (so the comparison reaches
    the scan); text or timestamp columns are parsed first.
    """
    out: list[Column] = []
    is_date = isinstance(df.schema[name].dataType, DateType)
    value = F.col(name) if is_date else parse_or_null(df, name)
    if spec.date_start:
        start = _day(spec.date_start)
        if is_date:
            first = start.date() if start.time() == dt.time(0) else start.date() + dt.timedelta(days=1)
            out.append(value >= F.lit(first))
        else:
            out.append(value >= _wall_clock(start))
        if prune_months:
            out.append(F.col("order_month") >= F.lit(start.strftime("%Y-%m")))
    if spec.date_end:
        end = _day(spec.date_end)
        out.append(value <= (F.lit(end.date()) if is_date else _wall_clock(end)))
        if prune_months:
            out.append(F.col("order_month") <= F.lit(end.strftime("%Y-%m")))
    return out


def predicate(df: DataFrame, spec: SalesFilter | None) -> Column | None:
    """The conjunction of every applicable filter, or ``None``; of a long list only its bounds."""
    if spec is None:
        return None
    cols = set(df.columns)
    parts: list[Column] = []

    date_col = date_column(df)
    if date_col is not None and (spec.date_start or spec.date_end):
        parts += _date_bounds(df, date_col, spec, "order_month" in cols and date_col == "order_date")

    for name in LIST_COLUMNS:
        values = _as_list(getattr(spec, name))
        if name in cols and len(values) > LONG_LIST:
            parts.append(F.col(name).between(F.lit(min(values)), F.lit(max(values))))
        elif name in cols and values:
            parts.append(F.col(name).isin(values))

    if "revenue" in cols:
        if spec.revenue_min is not None and spec.revenue_min != "":
            parts.append(F.col("revenue") >= _decimal_bound(df, float(spec.revenue_min), True))
        if spec.revenue_max is not None and spec.revenue_max != "":
            parts.append(F.col("revenue") <= _decimal_bound(df, float(spec.revenue_max), False))

    if "product" in cols and spec.product_search:
        search = spec.product_search.lower().strip()
        if search:
            if spec.product_literal:
                parts.append(F.contains(F.lower(F.col("product")), F.lit(search)))
            else:
                re.compile(search)  # an invalid pattern fails while the plan is built
                parts.append(F.lower(F.col("product")).rlike(search))

    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def apply_filters(df: DataFrame, spec: SalesFilter | None) -> DataFrame:
    """rows passing every applicable filter (input unchanged when none)."""
    cond = predicate(df, spec)
    out = df.where(cond) if cond is not None else df
    for name in LIST_COLUMNS if spec is not None else ():
        values = _as_list(getattr(spec, name))
        if name in df.columns and len(values) > LONG_LIST:
            out = _members(out, name, values)
    return out


def _members(df: DataFrame, name: str, values: list) -> DataFrame:
    """Rows whose value is in a long list: a semi join, the columns as they were."""
    distinct = sorted({str(v) for v in values})
    listed = df.sparkSession.createDataFrame(pa.table({"__member": pa.array(distinct, pa.string())}))
    if sum(len(v.encode("utf-8")) + 16 for v in distinct) <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    return df.join(listed, df[name] == listed["__member"], "left_semi").select(*df.columns)


def date_presets(df: DataFrame) -> DataFrame:
    """(label, start, end) ranges anchored at the latest date.

    One global ``max`` (partial per task), then four rows built from it.
    """
    names = date_columns_ci(df)
    schema = "label string, date_start string, date_end string"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    anchor_df = df.agg(F.max(as_date(df, names[0])).alias("a")).where(F.col("a").isNotNull())
    a = F.col("a")
    q_start = F.trunc(F.add_months(a, -3), "quarter")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd")
    def row(order: int, label: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(order).alias("ord"), F.lit(label).alias("label"),
                        fmt(start).alias("s"), fmt(end).alias("e"))
    presets = F.array(
        row(1, "Last 7 days", F.date_sub(a, 6), a),
        row(2, "This month", F.trunc(a, "month"), a),
        row(3, "Last quarter", q_start, F.last_day(F.add_months(q_start, 2))),
        row(4, "This year", F.trunc(a, "year"), a),
    )
    return (anchor_df.select(F.inline(presets))
            .select("label", F.col("s").alias("date_start"), F.col("e").alias("date_end"), "ord")
            .orderBy("ord").drop("ord"))
