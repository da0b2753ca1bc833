"""Identity mentions: which groups a comment refers to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand import fixed_values as fv
from evenhand.functions.numbers import lenient_number
from evenhand.functions.unnest import explode_rows


def present_groups(df: DataFrame, groups: Sequence[str]) -> list[str]:
    """The groups that have a column; the others are tolerated and skipped."""
    return [g for g in groups if g in df.columns]


def mention_flag(df: DataFrame, group: str, threshold: float) -> Column:
    """True where the group's value, text or number, reaches the threshold. NaN does not,
    although it compares above every number."""
    value = F.col(group)
    if isinstance(df.schema[group].dataType, T.StringType):
        return lenient_number(value) >= F.lit(threshold)
    if isinstance(df.schema[group].dataType, T.FractionalType):
        return (value >= F.lit(threshold)) & ~F.isnan(value)
    return value >= F.lit(threshold)


def mention_flags(df: DataFrame, groups: Sequence[str], threshold: float) -> list[Column]:
    return [mention_flag(df, g, threshold) for g in present_groups(df, groups)]


def mention_array(
    df: DataFrame, groups: Sequence[str], threshold: float = fv.MENTION_THRESHOLD
) -> Column:
    """Mentioned groups in the order of ``groups``."""
    names = present_groups(df, groups)
    if not names:
        return F.array().cast("array<string>")
    flags = mention_flags(df, names, threshold)
    return F.array_compact(F.array(*[F.when(f, F.lit(g)) for g, f in zip(names, flags)]))


def mention_rows(
    df: DataFrame, groups: Sequence[str], threshold: float = fv.MENTION_THRESHOLD
) -> DataFrame:
    """Rows with at least one mention, with a ``mentions`` array.

    Numeric columns are filtered by an OR of plain comparisons first, which a columnar scan
    can use; it lets NaN pass, so the exact condition follows.
    """
    names = present_groups(df, groups)
    if not names:
        return df.withColumn("mentions", mention_array(df, names)).filter(F.lit(False))
    any_mention = reduce(or_, mention_flags(df, names, threshold))
    if not any(isinstance(df.schema[g].dataType, T.StringType) for g in names):
        df = df.filter(reduce(or_, [F.col(g) >= F.lit(threshold) for g in names]))
    return df.filter(any_mention).withColumn("mentions", mention_array(df, names, threshold))


def identity_long(
    df: DataFrame,
    groups: Sequence[str],
    keep: Sequence[str | Column],
    threshold: float = fv.MENTION_THRESHOLD,
) -> DataFrame:
    """One row (*keep, identity) per comment and mentioned group."""
    rows = mention_rows(df, groups, threshold)
    return explode_rows(rows, keep, F.col("mentions"), "identity")
