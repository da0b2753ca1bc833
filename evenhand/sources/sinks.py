"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evenhand import fixed_values as fv


#: Fields are written as they are; the writer would cut white space at their ends.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_table(
    df: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists"
) -> None:
    """A result table without an index column; CSV gets a header."""
    writer = df.write.mode(mode)
    if file_format == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.format(file_format).save(path)


def write_variants(
    variants: DataFrame, path: str, file_format: str = "csv", mode: str = "errorifexists"
) -> None:
    """One folder per stratum with the fixed columns; an empty stratum gets none."""
    writer = (
        variants.select(*fv.VARIANT_COLUMNS, "stratum").write.mode(mode).partitionBy("stratum")
    )
    if file_format == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.format(file_format).save(path)
