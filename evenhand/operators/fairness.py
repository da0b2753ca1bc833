"""Fairness metrics over a scored audit table.

The table has one row per sentence: ``level``, template columns, ``category``,
``identity_term`` and one or more score columns. Every metric first combines the rows per
term (or per template and term), so later steps see at most levels x terms rows, a size set
by the audit's own term list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand import fixed_values as fv

TIE_DIGITS = 12  # means that differ only by the order of summation count as equal


def attach_scores(
    sentences: DataFrame, scores: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Left join to an external score table with one row per key; a sentence without a score
    keeps NULL. A sentence copied very often makes its partition large; adaptive execution
    splits such a partition of the left side and repeats the few matching score rows."""
    return sentences.join(scores, list(keys), "left")


def at_level(audit: DataFrame, level: str) -> DataFrame:
    return audit.filter(F.col("level") == level)


def parity(audit: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Mean of each score by identity term and level."""
    return audit.groupBy("identity_term", "level").agg(*[F.avg(s).alias(s) for s in scores])


def parity_pivot(
    audit: DataFrame,
    score: str,
    order_by: str | None = None,
    levels: Sequence[str] = fv.LEVELS,
) -> DataFrame:
    """Mean score per term, one column per level, and the term's position by the first
    level's mean of ``order_by`` (another model's score, or the score itself).

    Both means come from one grouping, so the second model is aligned without a join.
    """
    lead = order_by or score
    pivoted = audit.groupBy("identity_term").agg(
        *[F.avg(F.when(F.col("level") == lv, F.col(score))).alias(lv) for lv in levels],
        F.round(F.avg(F.when(F.col("level") == levels[0], F.col(lead))), TIE_DIGITS).alias("lead"),
    )
    position = F.row_number().over(W.orderBy(F.asc_nulls_last("lead"), "identity_term"))
    return pivoted.withColumn("position", position).drop("lead").orderBy("position")


def level_means(audit: DataFrame, level: str, scores: Sequence[str]) -> DataFrame:
    """Mean of the scores per term on one level, highest last score first."""
    means = at_level(audit, level).groupBy("identity_term").agg(
        *[F.avg(s).alias(s) for s in scores]
    )
    return means.orderBy(F.desc(scores[-1]), "identity_term")


def _tied(column: str) -> Column:
    return F.round(F.col(column), TIE_DIGITS)


def extremes(means: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group of term means: minimum, maximum, their terms (first name wins a tie) and
    the range."""
    return means.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.min(value).alias("min_mean"),
        F.min_by("identity_term", F.struct(_tied(value), "identity_term")).alias("min_term"),
        F.max(value).alias("max_mean"),
        F.min_by("identity_term", F.struct(-_tied(value), "identity_term")).alias("max_term"),
        (F.max(value) - F.min(value)).alias("range"),
    )


def level_range(audit: DataFrame, score: str) -> DataFrame:
    return extremes(parity(audit, [score]), ["level"], score)


def category_spread(
    audit: DataFrame, score: str, level: str | None = fv.LEVELS[0]
) -> DataFrame:
    """Largest minus smallest term mean inside each category, and their ratio."""
    rows = audit if level is None else at_level(audit, level)
    means = rows.groupBy("category", "identity_term").agg(F.avg(score).alias("mean"))
    return extremes(means, ["category"], "mean").withColumn(
        "ratio", F.col("max_mean") / F.nullif(F.col("min_mean"), F.lit(0.0))
    )


def group_ratio(audit: DataFrame, score: str) -> DataFrame:
    """Largest over smallest term mean per level; NULL when the smallest is 0."""
    return level_range(audit, score).select(
        "level",
        "max_term",
        "min_term",
        (F.col("max_mean") / F.nullif(F.col("min_mean"), F.lit(0.0))).alias("ratio"),
    )


def gap_growth(audit: DataFrame, score: str, levels: Sequence[str] = fv.LEVELS) -> DataFrame:
    """One row: the range of term means per level and its growth from the first level."""
    ranges = level_range(audit, score)
    return ranges.agg(
        *[F.max(F.when(F.col("level") == lv, F.col("range"))).alias(f"range_{lv}") for lv in levels]
    ).select(
        "*",
        *[
            (F.col(f"range_{lv}") - F.col(f"range_{levels[0]}")).alias(f"growth_{lv}")
            for lv in levels[1:]
        ],
    )


def pairwise_difference(
    audit: DataFrame,
    score: str,
    template_keys: Sequence[str] = ("template",),
    within_category: bool = True,
) -> DataFrame:
    """Counterfactual score difference by level: number of term pairs in the same template,
    mean and maximum absolute difference.

    No pairs are formed. In ascending order, the score at position i of n enters the sum of
    all absolute differences with weight 2i - n - 1, and the maximum is the group's range.
    A template's group holds one averaged score per term, at most the length of the term list.
    """
    group = ["level", *template_keys, *(["category"] if within_category else [])]
    per_term = (
        audit.filter(F.col(score).isNotNull())
        .groupBy(*group, "identity_term")
        .agg(F.avg(score).alias("score"))
    )
    n = F.size("scores")
    weighted = F.aggregate(
        F.zip_with(
            "scores",
            F.sequence(F.lit(1), n),
            lambda value, i: value * (2 * i - n - 1),
        ),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    sums = (
        per_term.groupBy(*group)
        .agg(F.sort_array(F.collect_list("score")).alias("scores"))
        .select(
            "level",
            (n * (n - 1) / 2).cast("long").alias("pairs"),
            weighted.alias("total"),
            (F.element_at("scores", -1) - F.element_at("scores", 1)).alias("largest"),
        )
    )
    return sums.groupBy("level").agg(
        F.sum("pairs").alias("n_pairs"),
        (F.sum("total") / F.nullif(F.sum("pairs"), F.lit(0))).alias("mean_abs_diff"),
        F.max(F.when(F.col("pairs") > 0, F.col("largest"))).alias("max_abs_diff"),
    )


def average_rank(value: Column, by: Sequence[str]) -> Column:
    """Rank with ties sharing the mean of their positions."""
    order = W.partitionBy(*by).orderBy(value)
    ties = F.count("*").over(W.partitionBy(*by, value))
    return F.rank().over(order) + (ties - 1) / 2


def rank_agreement(
    audit: DataFrame, score: str, levels: Sequence[str] = fv.LEVELS
) -> DataFrame:
    """Spearman correlation of the term means between each two levels."""
    ranked = (
        parity(audit, [score])
        .filter(F.col(score).isNotNull())
        .withColumn("rank", average_rank(_tied(score), ["level"]))
    )
    wide = ranked.groupBy("identity_term").agg(
        *[F.max(F.when(F.col("level") == lv, F.col("rank"))).alias(lv) for lv in levels]
    )
    pairs = [(a, b) for i, a in enumerate(levels) for b in levels[i + 1 :]]
    return wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("level_a"),
                        F.lit(b).alias("level_b"),
                        F.col(f"c{i}").alias("spearman"),
                    )
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


def model_agreement(audit: DataFrame, first: str, second: str) -> DataFrame:
    """Per level: Pearson correlation of the sentence scores and Spearman correlation of the
    term means of two models."""
    by_row = audit.groupBy("level").agg(F.corr(first, second).alias("pearson"))
    ranked = (
        parity(audit, [first, second])
        .na.drop(subset=[first, second])
        .withColumn("rank_a", average_rank(_tied(first), ["level"]))
        .withColumn("rank_b", average_rank(_tied(second), ["level"]))
    )
    by_term = ranked.groupBy("level").agg(F.corr("rank_a", "rank_b").alias("spearman"))
    return by_row.join(by_term, "level", "left")


def variant_gaps(scored: DataFrame, score: str, key: str = "id") -> DataFrame:
    """Score of each counterfactual minus the score of its original.

    ``scored`` is a variant table with a score column; the rows of one comment are few
    (one per mention and the original).
    """
    same = W.partitionBy(key)
    original = F.max(F.when(F.col("is_original") == "true", F.col(score))).over(same)
    return (
        scored.withColumn("original_score", original)
        .filter(F.col("is_original") == "false")
        .select(
            key,
            "variant_id",
            F.col(score).alias("variant_score"),
            "original_score",
            (F.col(score) - F.col("original_score")).alias("score_gap"),
        )
    )


def summarise_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("variant_id").agg(
        F.count("*").alias("n_variants"),
        F.avg("score_gap").alias("mean_gap"),
        F.avg(F.abs("score_gap")).alias("mean_abs_gap"),
        F.max(F.abs("score_gap")).alias("max_abs_gap"),
    )
