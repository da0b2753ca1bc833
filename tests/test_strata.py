import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenhand.operators import ranks, strata


def frame(spark, pairs, key_type="long"):
    return spark.createDataFrame(pairs, f"toxicity double, id {key_type}")


def expected(pairs, top, middle, bottom):
    ordered = sorted(pairs)
    start = max(0, len(ordered) // 2 - middle // 2)
    return {
        "bottom": ordered[:bottom],
        "middle": ordered[start : start + middle],
        "top": ordered[len(ordered) - min(top, len(ordered)) :],
    }


def found(df):
    out = {"bottom": [], "middle": [], "top": []}
    for r in df.collect():
        out[r["stratum"]].append((r["toxicity"], r["id"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("key_type", ["long", "string"])
@pytest.mark.parametrize("sortable", [200_000, 20])
def test_strata_with_a_score_holding_most_rows(spark, sortable, key_type):
    rng = random.Random(5)
    pairs = [(0.5 if rng.random() < 0.6 else round(rng.random(), 2), i) for i in range(1500)]
    if key_type == "string":
        pairs = [(s, f"k{i}") for s, i in pairs]
    df = strata.stratify(frame(spark, pairs, key_type), "toxicity", "id", 70, 60, 50, sortable)
    assert found(df) == expected(pairs, 70, 60, 50)


@pytest.mark.parametrize("n", [0, 1, 3, 5])
@pytest.mark.parametrize("size", [0, 1, 2, 100])
def test_overlap_and_sizes(spark, n, size):
    pairs = [(float(i % 2), i) for i in range(n)]
    df = strata.stratify(frame(spark, pairs), "toxicity", "id", size, size, size)
    assert found(df) == expected(pairs, size, size, size)


def test_summary_and_ranking(spark):
    pairs = [(0.1 * i, i) for i in range(10)]
    df = frame(spark, pairs)
    summary = strata.summarise_strata(strata.stratify(df, "toxicity", "id", 2, 2, 3), "toxicity")
    rows = {r["stratum"]: (r["n"], r["min_score"], r["max_score"]) for r in summary.collect()}
    assert rows["bottom"] == (3, 0.0, 0.2)
    assert rows["top"][0] == 2
    assert [r["id"] for r in strata.ranked(df.repartition(3), "toxicity", "id").collect()] == list(range(10))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=120), st.integers(0, 1000))
def test_keys_at_ranks_equal_sorting(spark, values, seed):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ordered = sorted(values)
    wanted = sorted({seed % len(values), 0, len(values) - 1, len(values) // 2})
    got = ranks.keys_at_ranks(df, ["v"], wanted, len(values), sortable_rows=4)
    assert got == {r: (float(ordered[r]),) for r in wanted}


def test_positions_of_a_sorted_table(spark):
    """Ties by key, a score that holds most rows, empty partitions, an empty table."""
    rows = [(i, 0.5 if i % 3 else (i * 7 % 11) / 11, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, toxicity double, position string").drop("position").repartition(7)
    found = strata.with_position(strata.ranked(df, "toxicity", "id")).collect()
    expected = sorted((s, i) for i, s, _ in rows)
    assert sorted((r["position"], r["toxicity"], r["id"]) for r in found) == [(n, s, i) for n, (s, i) in enumerate(expected, 1)]
    assert strata.with_position(strata.ranked(df.limit(0), "toxicity", "id")).collect() == []


def test_positions_of_identities(spark):
    from evenhand.operators import profile

    rows = [("b", 0.5), ("a", 0.5 + 1e-15), ("c", 0.9), ("d", None)]
    df = spark.createDataFrame(rows, "identity string, mean_toxicity double")
    assert {r["identity"]: r["position"] for r in profile.with_position(df).collect()} == {"c": 1, "a": 2, "b": 3, "d": 4}
