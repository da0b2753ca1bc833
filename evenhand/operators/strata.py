"""Bottom, middle and top strata of a scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand import fixed_values as fv
from evenhand.operators import ranks
from evenhand.sources.shared import checkpointed

STRATA = ["bottom", "middle", "top"]


def ranked(df: DataFrame, score: str, key: str) -> DataFrame:
    """Ascending global order; ties are ordered by the key. A range-partitioned sort."""
    return df.orderBy(score, key)


def with_position(ordered: DataFrame, column: str = "position") -> DataFrame:
    """Adds the 1-based place of every row of a globally sorted table.

    A sort leaves range partitions, so a row's place is the number of rows in the partitions before
    plus its place in its own: no row passes a window over the whole table. The sorted rows are
    kept in the shared folder, because a second sort would draw other borders. One row for each
    partition is broadcast.
    """
    kept = checkpointed(ordered)
    numbered = kept.select(
        "*",
        F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("__row"),
    )
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = (
        numbered.groupBy("__part")
        .count()
        .select("__part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    )
    place = F.col("__before") + F.col("__row") + 1
    return numbered.join(F.broadcast(before), "__part").select(*ordered.columns, place.alias(column))


def middle_range(n_rows: int, middle_n: int) -> tuple[int, int]:
    """Half-open rank range of ``middle_n`` rows centred on the median rank."""
    start = max(0, n_rows // 2 - middle_n // 2)
    return start, min(n_rows, start + middle_n)


def stratify(
    df: DataFrame,
    score: str,
    key: str,
    top_n: int = fv.STRATUM_SIZE,
    middle_n: int = fv.STRATUM_SIZE,
    bottom_n: int = fv.STRATUM_SIZE,
    sortable_rows: int = ranks.SORTABLE_ROWS,
) -> DataFrame:
    """The rows of the three strata with a ``stratum`` column.

    ``key`` must identify a row. A row in several strata appears once for each. The order
    keys at the strata's borders are found first; membership is then a comparison with
    constants on the way out of the scan, without a shuffle or a join.
    """
    scored = df.filter(F.col(score).isNotNull())
    # The search reads the order keys several times; only these two columns are kept, and a
    # lost executor's share is computed again from the input.
    keys = scored.select(score, key).persist()
    n_rows = keys.count()
    start, end = middle_range(n_rows, middle_n)
    spans = {
        "bottom": (0, min(bottom_n, n_rows)),
        "middle": (start, end),
        "top": (max(0, n_rows - top_n), n_rows),
    }
    spans = {name: (a, b) for name, (a, b) in spans.items() if a < b}
    if not spans:
        keys.unpersist()
        return scored.withColumn("stratum", F.lit("")).filter(F.lit(False))

    columns = [score, key]
    types = [df.schema[c].dataType for c in columns]
    edges = ranks.keys_at_ranks(
        keys, columns, [r for a, b in spans.values() for r in (a, b - 1)], n_rows, sortable_rows
    )
    keys.unpersist()
    member = {
        name: ranks.after(columns, types, edges[a], True)
        & ranks.before(columns, types, edges[b - 1], True)
        for name, (a, b) in spans.items()
    }
    anywhere = F.lit(False)
    for condition in member.values():
        anywhere = anywhere | condition
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in member.items()]))
    return scored.filter(anywhere).withColumn("stratum", F.explode(names))


def summarise_strata(strata: DataFrame, score: str) -> DataFrame:
    return strata.groupBy("stratum").agg(
        F.count("*").alias("n"), F.min(score).alias("min_score"), F.max(score).alias("max_score")
    )
