"""Date helpers: one layout per text column, parse-or-null, month and day buckets.

A text column is read by ONE layout, the one that most of its values fit (ties: the
earlier in ``LAYOUTS``, so month first).  Values of any other layout are null: in a
day-first column ``03/04/2024`` is 3 April on every row.  The vote is one aggregate
over the column; each value is parsed only by the layouts whose shape it has.

All results are TIMESTAMP_NTZ: what the text says, whatever zone the driver or the
session is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from ..schema import MONTH_FORMAT, col

_TIME = "[ H:mm[:ss]]"
_TIME_SHAPE = r"(?: \d{1,2}:\d\d(?::\d\d)?)?$"

_MONTH, _DAY = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"

# (mark, shape, layout), in the order that settles ties; ISO has no layout of its own.
# A time alone is no date: it would turn into the current day.  A shape holds no month
# or day that there never is: a text that fails in the parser costs many times one that
# does not reach it.  Texts without the mark need no look at the shape.
LAYOUTS: tuple[tuple[str, str, str | None], ...] = (
    ("-", r"^[+-]?\d{4,}-\d", None),
    ("/", f"^{_MONTH}/{_DAY}" + r"/\d{4}" + _TIME_SHAPE, f"M/d/yyyy{_TIME}"),
    ("/", f"^{_DAY}/{_MONTH}" + r"/\d{4}" + _TIME_SHAPE, f"d/M/yyyy{_TIME}"),
    ("-", f"^{_MONTH}-{_DAY}" + r"-\d{4}" + _TIME_SHAPE, f"M-d-yyyy{_TIME}"),
    ("-", f"^{_DAY}-{_MONTH}" + r"-\d{4}" + _TIME_SHAPE, f"d-M-yyyy{_TIME}"),
    ("/", r"^\d{4}/" + f"{_MONTH}/{_DAY}" + _TIME_SHAPE, f"yyyy/M/d{_TIME}"),
    (".", f"^{_DAY}\\.{_MONTH}" + r"\.\d{4}" + _TIME_SHAPE, f"d.M.yyyy{_TIME}"),
    (",", r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (" ", r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    ("", r"^\d{8}$", "yyyyMMdd"),
)


def is_text_date(df: DataFrame, name: str) -> bool:
    """Does the column need a layout at all?"""
    return not isinstance(df.schema[name].dataType, (DateType, TimestampType, TimestampNTZType))


def _read(text: Column, layout: int) -> Column:
    mark, shape, pattern = LAYOUTS[layout]
    parsed = F.try_to_timestamp(text) if pattern is None else F.try_to_timestamp(text, F.lit(pattern))
    return F.when(text.contains(mark) & text.rlike(shape), parsed.cast("timestamp_ntz"))


def _text(name: str) -> Column:
    return F.trim(col(name).cast(StringType()))


def layout_votes(name: str) -> list[Column]:
    """One count per layout: values of the column that it reads.  Aggregates of one pass."""
    return [F.count(_read(_text(name), i)) for i in range(len(LAYOUTS))]


def winner(counts: list[int]) -> int:
    """The layout with most votes; ties go to the earlier."""
    return max(range(len(counts)), key=lambda i: (counts[i], -i))


def column_layout(df: DataFrame, name: str) -> Column:
    """The voted layout as a scalar subquery, for plans that read the column once more."""
    votes = df.agg(F.array(*layout_votes(name)).alias("v"))
    return votes.select((F.array_position("v", F.array_max("v")) - 1).cast("int")).scalar()


def parse_or_null(df: DataFrame, name: str, layout: int | Column | None = None) -> Column:
    """Wall-clock value of column ``name``; text that its layout does not read becomes null.

    ``layout`` is what a caller knows from its own vote; else the vote is part of the plan.
    """
    if not is_text_date(df, name):
        return col(name).cast("timestamp_ntz")
    if isinstance(layout, int):
        return _read(_text(name), layout)
    chosen = column_layout(df, name) if layout is None else layout
    return F.coalesce(*[F.when(chosen == i, _read(_text(name), i)) for i in range(len(LAYOUTS))])


def as_date(df: DataFrame, name: str, layout: int | None = None) -> Column:
    """Calendar day of column ``name`` (DATE), null when unparseable."""
    if isinstance(df.schema[name].dataType, DateType):
        return col(name)
    return parse_or_null(df, name, layout).cast("date")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_label(day: Column) -> Column:
    return F.date_format(day, MONTH_FORMAT)
