"""Arrays to rows.

For a plain explode the optimizer adds a filter "array is not empty" and pushes it down to
the scan, which evaluates an expensive array expression twice, the first time before any
redistribution. The outer forms followed by a filter on the produced column give the same
rows and evaluate the array once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    df: DataFrame, keep: Sequence[str | Column], array: Column, name: str
) -> DataFrame:
    """(*keep, name): one row per non-NULL element."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def inline_rows(
    df: DataFrame, keep: Sequence[str | Column], structs: Column, required: str
) -> DataFrame:
    """(*keep, *fields): one row per struct; the field ``required`` is never NULL in them."""
    return df.select(*keep, F.inline_outer(structs)).filter(F.col(required).isNotNull())
