"""Reading annotated comments, and tables of external scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.functions.numbers import lenient_number, nan_to_null
from evenhand.sources.records import csv_records, folder_value


def csv_options(reader):
    """Header, UTF-8, quoted fields that may hold newlines and doubled quotes."""
    return (
        reader.option("header", True)
        .option("encoding", "UTF-8")
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
    )


def csv_rows(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, whole_files: bool = False
) -> DataFrame:
    """All fields as text, named by the header; only ``columns`` are parsed when given.

    Every file is read by many tasks, although fields may hold newlines (``records``). With
    ``whole_files`` one task reads a whole file: for files in which quotes stand inside unquoted fields or
    lines end in a carriage return alone.
    """
    # Without inference only the header line is read to learn the names.
    df = csv_options(spark.read).option("inferSchema", False).csv(path)
    if not whole_files:
        df = parsed(spark, path, df.schema).select("row.*", *folder_columns(spark, path))
    return df if columns is None else df.select(*columns)


def folder_columns(spark: SparkSession, path: str) -> list[str]:
    """Columns that come from folder names and not from the files."""
    return spark.read.text(path).columns[1:]


def parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(doc_no, row, *folder columns): the data records' fields by the same parser that reads files."""
    outside = folder_columns(spark, path)
    fields = T.StructType([f for f in schema.fields if f.name not in outside])
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    return (
        csv_records(spark, path)
        .filter("record_no > 0")
        .select(
            "doc_no",
            F.from_csv("record", fields.toDDL(), options).alias("row"),
            *[folder_value(F.col("file"), c).cast(schema[c].dataType).alias(c) for c in outside],
        )
    )


def comments(
    df: DataFrame,
    groups: Sequence[str],
    score: str = "target",
    key: str | None = "id",
    text: str = "comment_text",
) -> DataFrame:
    """Typed comments (id, comment_text, target, *groups) from rows of text or numbers.

    Fails when the score column is absent. Group columns may be absent. Missing numbers are
    NULL here; a text that is no number is NULL too.
    """
    if score not in df.columns:
        raise ValueError(f"no score column {score!r} among {df.columns}")

    def number(column: str):
        if isinstance(df.schema[column].dataType, T.StringType):
            return F.when(F.col(column) != "", lenient_number(F.col(column)))
        return nan_to_null(F.col(column).cast("double"))

    present = [g for g in groups if g in df.columns]
    identifier = [F.col(key).alias("id")] if key and key in df.columns else []
    return df.select(
        *identifier,
        F.when(F.col(text) != "", F.col(text)).alias("comment_text"),
        number(score).alias("target"),
        *[number(g).alias(g) for g in present],
    )


def rank_score(df: DataFrame, score: str) -> DataFrame:
    """Adds ``toxicity`` for ranking: missing is 0, rows with unparsable text are dropped."""
    if score not in df.columns:
        raise ValueError(f"no score column {score!r} among {df.columns}")
    if isinstance(df.schema[score].dataType, T.StringType):
        value = lenient_number(F.col(score))
    else:
        value = F.coalesce(nan_to_null(F.col(score).cast("double")), F.lit(0.0))
    return df.withColumn("toxicity", value).filter(F.col("toxicity").isNotNull())


def with_file_order(df: DataFrame, column: str = "doc_index") -> DataFrame:
    """0-based position over all files, for tables without a key.

    ``df`` must come straight from a file scan. Rows are numbered inside each file block
    where they are read; a block's offset is the row count of the blocks before it. Only the
    per-block counts (one row per block) are ordered. Spark broadcasts them while they are
    small, so that the table itself is not shuffled.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    )
    blocks = placed.groupBy("__file", "__start").agg(
        F.min("__id").alias("__first"), F.count("*").alias("__n")
    )
    earlier = W.orderBy("__file", "__start").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.withColumn(
        "__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    ).drop("__n")
    return (
        placed.join(offsets, ["__file", "__start"])
        .withColumn(column, F.col("__offset") + F.col("__id") - F.col("__first"))
        .drop("__file", "__start", "__id", "__first", "__offset")
    )


def indexed_comments(spark: SparkSession, path: str) -> DataFrame:
    """(doc_index, comment_text, target) in file order, absent fields as '' and '0'."""
    schema = csv_options(spark.read).option("inferSchema", False).csv(path).schema
    names = schema.names
    rows = parsed(spark, path, schema).select(F.col("doc_no").alias("doc_index"), "row.*")
    text = F.col("comment_text") if "comment_text" in names else F.lit("")
    target = F.col("target") if "target" in names else F.lit("0")
    return rows.select(
        "doc_index",
        F.coalesce(text, F.lit("")).alias("comment_text"),
        F.coalesce(target, F.lit("")).alias("target"),
    )


def to_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def external_scores(
    spark: SparkSession, path: str, keys: Sequence[str], score: str, file_format: str = "csv"
) -> DataFrame:
    """Scores returned by an external scorer: (*keys, score as double)."""
    if file_format == "csv":
        rows = csv_rows(spark, path)
        value = F.when(F.col(score) != "", lenient_number(F.col(score)))
    else:
        rows = spark.read.format(file_format).load(path)
        value = F.col(score).cast("double")
    return rows.select(*keys, value.alias(score))


def unscored(variants: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that no score has come back for, to be sent out again. Only the keys of the scores
    take part; a score that is missing in a returned row counts as not returned."""
    returned = scores.filter(F.col(scores.columns[-1]).isNotNull()).select(*keys).distinct()
    return variants.join(returned, list(keys), "left_anti")
