"""Text helpers: number formatting, whitespace collapse, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Below this magnitude ``format_number`` (17 significant digits) shows the
# exact binary value to two decimals; above it the integer and fractional
# parts are formatted separately, as Python's format does.
_EXACT_SPLIT = 1e14
_BIGINT_LIMIT = 9.2e18


def _fixed_text(c: Column, digits: int, grouping: bool) -> Column:
    """Fixed-point text of a DOUBLE with Python's digits at any magnitude."""
    x = c.cast("double")
    simple = F.format_number(x, digits)
    whole = F.when(F.abs(x) < _BIGINT_LIMIT, x).cast("bigint")  # exact: truncates an exact double
    frac = F.format_number(F.abs(x - whole.cast("double")), digits)  # "0.xx", or "1.00" on a carry
    carried = F.abs(whole) + F.when(F.substring(frac, 1, 1) == "1", 1).otherwise(0)
    exact = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.format_number(carried, 0),
                     F.substring(frac, 2, digits + 1))
    out = F.when(F.abs(x) < _EXACT_SPLIT, simple).when(F.abs(x) < _BIGINT_LIMIT, exact).otherwise(simple)
    return out if grouping else F.regexp_replace(out, ",", "")


def money(c: Column) -> Column:
    """``{:,.2f}``: thousands separators, two decimals, binary-exact rounding."""
    return _fixed_text(c, 2, True)


def grouped_int(c: Column) -> Column:
    """``{:,}`` for an integer."""
    return F.format_number(c.cast("bigint"), 0)


def fixed(c: Column, digits: int) -> Column:
    """``{:.Nf}``: fixed decimals, no separators."""
    return _fixed_text(c, digits, False)


def collapse_whitespace(c: Column) -> Column:
    """Runs of whitespace to one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def preview(c: Column, width: int = 180) -> Column:
    """Collapsed text cut to ``width`` characters, ``...`` when cut."""
    flat = collapse_whitespace(c)
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("..."))) \
        .otherwise(flat)
