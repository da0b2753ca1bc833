"""Profiles of a score column, overall and per identity group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand import fixed_values as fv
from evenhand.functions.numbers import nan_to_null, round_half_even
from evenhand.functions.text import preview, stable_hash
from evenhand.operators import ranks
from evenhand.operators.mentions import identity_long

TIE_DIGITS = 12
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def row_audit(df: DataFrame, required: Sequence[str], kept: Column | None = None) -> DataFrame:
    """One row: all rows, rows with every required column, dropped rows, and rows ``kept``."""
    complete = F.lit(True)
    for column in required:
        complete = complete & F.col(column).isNotNull()
    counts = [
        F.count("*").alias("n_rows"),
        F.count_if(complete).alias("n_complete"),
        F.count_if(~complete).alias("n_dropped"),
    ]
    if kept is not None:
        counts.append(F.count_if(F.coalesce(kept, F.lit(False))).alias("n_kept"))
    return df.agg(*counts)


def drop_missing(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(required))


def describe(df: DataFrame, score: str, sortable_rows: int = ranks.SORTABLE_ROWS) -> DataFrame:
    """Count, mean, sample deviation, minimum, interpolated quartiles and maximum.

    The exact quartiles come from the values at the neighbouring ranks, because the built-in
    ``percentile`` gathers every distinct value in one task.
    """
    values = df.select(nan_to_null(F.col(score).cast("double")).alias("value")).na.drop()
    values = values.persist()
    n_rows = values.count()
    quartiles = {name: (n_rows - 1) * q for name, q in QUARTILES.items()}
    wanted = [r for at in quartiles.values() for r in (int(at), min(int(at) + 1, n_rows - 1))]
    found = ranks.keys_at_ranks(values, ["value"], wanted, n_rows, sortable_rows) if n_rows else {}
    values.unpersist()

    def interpolated(at: float) -> float | None:
        if not n_rows:
            return None
        low, high = found[int(at)][0], found[min(int(at) + 1, n_rows - 1)][0]
        return low + (high - low) * (at - int(at))

    return values.agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        *[
            F.lit(interpolated(at)).cast("double").alias(name)
            for name, at in quartiles.items()
        ],
        F.max("value").alias("max"),
    )


def histogram(df: DataFrame, score: str, bins: int = fv.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed, empty bins kept.

    The bin found by division is moved by one where rounding put the value on the wrong side
    of an edge. A single value gets a range of one around it.
    """
    values = df.select(nan_to_null(F.col(score).cast("double")).alias("value")).na.drop()
    low = values.agg(F.min("value").alias("low")).scalar()
    high = values.agg(F.max("value").alias("high")).scalar()
    bounded = values.select("value", low.alias("lo0"), high.alias("hi0")).select(
        "value",
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.least(
        F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
        F.lit(bins - 1).cast("long"),
    )

    def edge(index: Column) -> Column:
        return F.when(index == bins, F.col("hi")).otherwise(F.col("lo") + index * width)

    counted = (
        bounded.withColumn("raw", raw)
        .withColumn(
            "bin",
            F.col("raw")
            - (F.col("value") < edge(F.col("raw"))).cast("long")
            + (
                (F.col("value") >= edge(F.col("raw") + 1)) & (F.col("raw") != bins - 1)
            ).cast("long"),
        )
        .groupBy("bin")
        .agg(F.count("*").alias("found"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    )
    # At most ``bins`` rows are left; one map of them gives the empty bins their zero.
    one_row = counted.agg(
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
        F.map_from_entries(F.collect_list(F.struct("bin", "found"))).alias("counts"),
    ).filter(F.col("lo").isNotNull())
    every_bin = F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))
    return one_row.select("lo", "hi", "counts", F.explode(every_bin).alias("bin")).select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        edge(F.col("bin") + 1).alias("bin_hi"),
        F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0)).alias("n"),
    )


def band_counts(
    df: DataFrame, score: str, bands: Sequence[tuple[str, float, float]] = fv.PROFILE_BANDS
) -> DataFrame:
    """Rows per right-closed band, in band order, empty bands included.

    One conditional count per band in a single pass. A score on the lowest edge, above the
    highest, or missing belongs to no band.
    """
    value = nan_to_null(F.col(score).cast("double"))
    one_row = df.agg(
        *[
            F.count_if((value > lo) & (value <= hi)).alias(f"b{i}")
            for i, (_, lo, hi) in enumerate(bands)
        ]
    )
    return one_row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("band_pos"),
                        F.lit(label).alias("band"),
                        F.col(f"b{i}").alias("n"),
                    )
                    for i, (label, _, _) in enumerate(bands)
                ]
            )
        )
    )


def identity_summary(
    df: DataFrame,
    groups: Sequence[str],
    score: str,
    threshold: float = fv.MENTION_THRESHOLD,
    toxic: float = fv.TOXIC_THRESHOLD,
    min_group_size: int = fv.MIN_GROUP_SIZE,
    rounded: bool = False,
) -> DataFrame:
    """Comments, mean score and percent toxic per identity, highest mean first.

    The mean skips missing scores, the percentage divides by all rows of the group. One
    pass: a row fans out to its mentioned groups only and is combined before the shuffle.
    """
    value = nan_to_null(F.col(score).cast("double"))
    long = identity_long(df, groups, [value.alias("value")], threshold)
    mean = F.avg("value")
    percent = 100 * F.avg(F.coalesce((F.col("value") >= toxic).cast("double"), F.lit(0.0)))
    if rounded:
        mean, percent = round_half_even(mean, 3), round_half_even(percent, 1)
    return (
        long.groupBy("identity")
        .agg(
            F.count("*").alias("n_comments"),
            mean.alias("mean_toxicity"),
            percent.alias("pct_toxic"),
        )
        .filter(F.col("n_comments") >= min_group_size)
        .orderBy(F.desc("mean_toxicity"), "identity")
    )


def with_position(summary: DataFrame) -> DataFrame:
    """Adds the place of every identity, highest mean first; means that differ by rounding errors
    only are ordered by name. One row for each group, so one window may hold them all."""
    order = W.orderBy(F.round("mean_toxicity", TIE_DIGITS).desc_nulls_last(), "identity")
    return summary.withColumn("position", F.row_number().over(order))


def band_samples(
    df: DataFrame,
    groups: Sequence[str],
    score: str,
    text: str,
    key: str,
    bands: Sequence[tuple[str, float, float]] = fv.SAMPLE_BANDS,
    threshold: float = fv.MENTION_THRESHOLD,
    seed: int = fv.SPLIT_SEED,
) -> DataFrame:
    """One pseudo-random comment per identity and half-open score band.

    The smallest seeded hash wins, ties by key. The minimum is combined before the shuffle
    (a window would sort a whole group in one task); its result has at most
    groups x bands rows, so it is safe to broadcast when the texts are fetched.
    """
    value = nan_to_null(F.col(score).cast("double"))
    band = F.coalesce(
        *[F.when((F.col("value") >= lo) & (F.col("value") < hi), name) for name, lo, hi in bands]
    )
    candidates = (
        identity_long(
            df.filter(F.col(text).isNotNull()),
            groups,
            [F.col(key).alias("key"), value.alias("value"), F.col(text).alias("text")],
            threshold,
        )
        .withColumn("band", band)
        .filter(F.col("band").isNotNull())
        .withColumn("hash", stable_hash(F.col("key"), seed))
    )
    winners = candidates.groupBy("identity", "band").agg(F.min("hash").alias("hash"))
    return (
        candidates.join(F.broadcast(winners), ["identity", "band", "hash"])
        .groupBy("identity", "band")
        .agg(F.min_by(F.struct("key", "value", "text"), "key").alias("row"))
        .select(
            "identity",
            "band",
            F.col("row.key").alias(key),
            F.col("row.value").alias("score"),
            preview(F.col("row.text")).alias("preview"),
        )
    )
