"""Number handling shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenhand import fixed_values as fv

# A decimal literal: digits may be grouped by single underscores, no type suffix.
_DIGITS = r"\d+(_\d+)*"
NUMBER_PATTERN = (
    rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
    r"|^[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])$"
)


def nan_to_null(value: Column) -> Column:
    """Missing floats arrive as NaN, which Spark orders above every number."""
    return F.nanvl(value, F.lit(None).cast("double"))


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, f"^[{fv.WHITESPACE}]+|[{fv.WHITESPACE}]+$", "")


def lenient_number(text: Column) -> Column:
    """Text to double: missing or empty is 0, anything unparsable is NULL."""
    trimmed = strip(text)
    parsed = F.when(
        trimmed.rlike(NUMBER_PATTERN), F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("double")
    )
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).otherwise(parsed)


def strict_number(text: Column) -> Column:
    """Text to double: missing or empty is 0, anything unparsable fails the job (ANSI cast)."""
    return F.when(text.isNull() | (text == ""), F.lit(0.0)).otherwise(text.cast("double"))


def round_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)
