"""Numeric coercion that agrees across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal number with optional sign and exponent, surrounding blanks allowed.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c: Column) -> Column:
    """DOUBLE value of text ``c``; anything that is not plainly a number is null."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def is_non_numeric(c: Column) -> Column:
    """True where ``c`` holds a value that does not read as a number."""
    return c.isNotNull() & ~F.coalesce(c.cast("string").rlike(NUMBER_PATTERN), F.lit(False))


def rate(part: Column, whole: Column) -> Column:
    """``(part / whole) * 100`` in DOUBLE, 0 when ``whole`` is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0),
                      F.lit(0.0))


def round_like_python(c: Column, digits: int = 2) -> Column:
    """``round(x, digits)`` on the exact binary value, ties to even.

    ``format_number`` rounds the exact double the same way; ``F.round``
    rounds its shortest decimal text half-up (2.675 -> 2.68, not 2.67).
    """
    from .text import fixed
    return fixed(c, digits).cast("double")
