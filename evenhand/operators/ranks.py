"""Exact order statistics of a large table without sorting it into one task.

A global row number needs all rows in one partition, and a rank inside a score value needs
all rows of that value in one, although a single score may cover a third of the table.
Instead the keys standing at the wanted ranks are found by narrowing: a random sample gives,
for every wanted rank, two splitters that very likely enclose its key; one counting pass says
below, between, above or on which splitters each rank really lies, and only that interval is
looked at again. A pass cuts a rank's interval to a few hundredths, so 10^11 rows need about
four passes and no shuffle of rows. Only the sample, the counts and the answers reach the
driver. The sample decides the speed, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
MARGIN = 4  # standard deviations between the expected place of a rank and its splitters
SORTABLE_ROWS = 64  # an interval of at most this many keys is sorted in one task


@dataclass(frozen=True)
class Interval:
    """Keys strictly between low and high: ``count`` of them, ``before`` keys come earlier."""

    low: tuple | None
    high: tuple | None
    before: int
    count: int


class _Keys:
    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.columns = list(columns)
        self.df = df.select(*columns)
        self.types = [df.schema[c].dataType for c in columns]

    def inside(self, interval: Interval) -> Column:
        condition = F.lit(True)
        if interval.low is not None:
            condition = condition & after(self.columns, self.types, interval.low, False)
        if interval.high is not None:
            condition = condition & before(self.columns, self.types, interval.high, False)
        return condition


def _compare(columns, types, key, inclusive, ascending) -> Column:
    """Row key against a literal key as an OR of plain column comparisons, which a columnar
    scan can use to skip row groups (a comparison of structs could not be pushed down)."""
    column, value = F.col(columns[0]), F.lit(key[0]).cast(types[0])
    beyond = column > value if ascending else column < value
    if len(columns) == 1:
        return (beyond | (column == value)) if inclusive else beyond
    rest = _compare(columns[1:], types[1:], key[1:], inclusive, ascending)
    return beyond | ((column == value) & rest)


def after(columns, types, key, inclusive: bool) -> Column:
    return _compare(columns, types, key, inclusive, True)


def before(columns, types, key, inclusive: bool) -> Column:
    return _compare(columns, types, key, inclusive, False)


def keys_at_ranks(
    df: DataFrame,
    columns: Sequence[str],
    ranks: Sequence[int],
    n_rows: int,
    sortable_rows: int = SORTABLE_ROWS,
) -> dict[int, tuple]:
    """Key (tuple of ``columns``) at each 0-based rank of the ascending order.

    ``columns`` must not hold NULL or NaN; ``n_rows`` is the number of rows of ``df``.
    """
    keys = _Keys(df, columns)
    answers: dict[int, tuple] = {}
    whole = Interval(None, None, 0, n_rows)
    waiting = {rank: whole for rank in set(ranks) if 0 <= rank < n_rows}
    round_number = 0
    while waiting:
        small = {r: i for r, i in waiting.items() if i.count <= sortable_rows}
        answers.update(_sort_small(keys, small))
        waiting = {r: i for r, i in waiting.items() if r not in small}
        if waiting:
            found, waiting = _narrow(keys, waiting, round_number)
            answers.update(found)
            round_number += 1
    return answers


def _sort_small(keys: _Keys, waiting: dict[int, Interval]) -> dict[int, tuple]:
    if not waiting:
        return {}
    intervals = list(dict.fromkeys(waiting.values()))
    slot = F.coalesce(*[F.when(keys.inside(i), F.lit(n)) for n, i in enumerate(intervals)])
    wanted = {(intervals.index(i), rank - i.before + 1): rank for rank, i in waiting.items()}
    order = W.partitionBy("__slot").orderBy(*keys.columns)
    rows = (
        keys.df.withColumn("__slot", slot)
        .filter(F.col("__slot").isNotNull())
        .withColumn("__rn", F.row_number().over(order))
        .filter(reduce(or_, [(F.col("__slot") == s) & (F.col("__rn") == n) for s, n in wanted]))
        .collect()
    )
    return {wanted[row["__slot"], row["__rn"]]: tuple(row[c] for c in keys.columns) for row in rows}


def _narrow(keys: _Keys, waiting: dict[int, Interval], round_number: int):
    intervals = list(dict.fromkeys(waiting.values()))
    chosen = reduce(
        or_,
        [
            keys.inside(i) & (F.rand(1_000 * round_number + n) < min(1.0, SAMPLE_ROWS / i.count))
            for n, i in enumerate(intervals)
        ],
    )
    # About SAMPLE_ROWS rows per interval; no limit, which would read partition by partition.
    sample = sorted(tuple(row) for row in keys.df.filter(chosen).collect())
    splitters = set()
    for i in intervals:
        own = [
            k
            for k in sample
            if (i.low is None or k > i.low) and (i.high is None or k < i.high)
        ]
        for rank in (r for r, interval in waiting.items() if interval == i and own):
            share = (rank - i.before) / i.count
            margin = MARGIN * (len(own) * share * (1 - share)) ** 0.5 + MARGIN
            for place in (share * len(own) - margin, share * len(own) + margin):
                splitters.add(own[int(min(max(place, 0), len(own) - 1))])
        splitters.update(k for k in (i.low, i.high) if k is not None)
    ordered = sorted(splitters)
    if not ordered:  # no row was drawn: draw again
        return {}, waiting

    # Slot 2p is the gap below splitter p, slot 2p + 1 the splitter itself, so a heavy key
    # is answered by its own slot and every other slot excludes it.
    slot = reduce(
        add,
        [
            after(keys.columns, keys.types, k, inclusive).cast("int")
            for k in ordered
            for inclusive in (True, False)
        ],
    )
    counts = {
        row["__slot"]: row["count"]
        for row in keys.df.filter(reduce(or_, [keys.inside(i) for i in intervals]))
        .groupBy(slot.alias("__slot"))
        .count()
        .collect()
    }
    found, still = {}, {}
    for rank, interval in waiting.items():
        first = 0 if interval.low is None else 2 * ordered.index(interval.low) + 2
        last = 2 * len(ordered) if interval.high is None else 2 * ordered.index(interval.high)
        seen = interval.before
        for s in range(first, last + 1):
            count = counts.get(s, 0)
            if rank < seen + count:
                if s % 2:
                    found[rank] = ordered[s // 2]
                else:
                    low = ordered[s // 2 - 1] if s else None
                    high = ordered[s // 2] if s // 2 < len(ordered) else None
                    still[rank] = Interval(low, high, seen, count)
                break
            seen += count
    return found, still
