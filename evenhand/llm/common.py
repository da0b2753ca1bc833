"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.sources.tables import PARTITIONS

#: A key that holds more than one of so many parts of all rows is hot, so at most so many keys are:
#: the session's shuffle partitions, and HOT_PARTS at least. A key that is not hot fits a partition.
HOT_PARTS = 512


def hot_parts(spark: SparkSession) -> int:
    return max(HOT_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the session may name a number of partitions to deal documents out to, which is of
    use where their file is a single row group."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    partitions = spark.conf.get(PARTITIONS, None)
    return found if partitions is None or name != "documents" else found.repartition(int(partitions))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by files in the shared folder that the session names.

    Only on one machine (tests) may `spark.checkpoint.dir` be unset: a folder of the warehouse is used
    then. On a cluster that may be a machine's own disk, so it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint()


def text_key(text: Column) -> Column:
    """A key that equal texts share; null is a text of its own."""
    return F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("null"))


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    spread: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Join `right` (one row per `key`, `weight` = its rows in `left`) to `left`.

    Hot keys (see `hot_parts`, so a proven bound) are looked up in a broadcast list; their rows
    go through the shuffle of the others on a hash of the `spread` columns, which matches
    nothing. `right` is read twice: hand over a checkpoint where it is dear. Null keys of
    `left` find nothing and are spread likewise.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).scalar()
    hot = right.filter(F.col(weight) > total / hot_parts(left.sparkSession)).select(
        F.col(key).alias("__hot_key"), F.struct(F.lit(1).alias("one"), *values).alias("__hot")
    )
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left").drop("__hot_key")
    alone = F.col("__hot").isNotNull() | F.col(key).isNull()
    marked = marked.withColumns(
        {
            "__salt": F.when(alone, F.xxhash64(*spread)).otherwise(F.lit(0)),
            "__side": F.when(alone, 1).otherwise(0),
        }
    )
    cold = right.select(
        F.col(key).alias("__cold_key"),
        F.lit(0).cast("long").alias("__cold_salt"),
        F.lit(0).alias("__cold_side"),
        F.struct(F.lit(1).alias("one"), *values).alias("__cold"),
    )
    joined = marked.join(
        cold,
        (F.col(key) == F.col("__cold_key"))
        & (F.col("__salt") == F.col("__cold_salt"))
        & (F.col("__side") == F.col("__cold_side")),
        "left",
    )
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    if how == "inner":
        joined = joined.filter(found.isNotNull())
    return joined.select(*left.columns, *[found[c].alias(c) for c in values])
