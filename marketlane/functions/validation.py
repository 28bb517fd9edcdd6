"""Request-shape checks on list inputs (the reference's array-of-number and
array-of-string tests), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_text


# Fixed value: texts that read as a number, blanks at the ends aside. An empty text is 0.
NUMBER = r"^([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)?$"


def is_array_of_numbers(arr: Column) -> Column:
    """Every element of an ARRAY<STRING> reads as a number: decimal, with an
    exponent, infinite, or hexadecimal, octal or binary with its prefix. Blanks around it
    do not count, an empty text and a NULL element are 0. An empty list passes, a NULL list fails."""
    def number(x: Column) -> Column:
        return F.coalesce(trim_text(x).rlike(NUMBER), F.lit(True))

    return F.coalesce(F.forall(arr, number), F.lit(False))


def is_array_of_strings(arr: Column) -> Column:
    """Every element is a non-NULL string (typed input: NULLs are the only
    way to fail)."""
    return F.coalesce(F.forall(arr, lambda x: x.isNotNull()), F.lit(False))
