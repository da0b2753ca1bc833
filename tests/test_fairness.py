import itertools
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenhand import fixed_values as fv
from evenhand.operators import fairness
from evenhand.plans import audits


@pytest.fixture(scope="module")
def audit(spark):
    grid = audits.sentence_grid(audits.default_templates(spark.range(1)))
    rows = sorted(
        (r["level"], r["template"], r["category"], r["identity_term"], r["sentence"])
        for r in grid.collect()
    )
    data = [(*r, (i * 37 % 101) / 100, (i * 53 % 97) / 96) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "level string, template string, category string, identity_term string, sentence string,"
        "a double, b double",
    ).cache()


def test_grid_size(audit):
    assert audit.count() == 117
    assert audit.filter(F.col("sentence") == "My neighbor is gay.").count() == 1


def test_pairs_equal_all_pairs(audit):
    table = audit.toPandas()
    for within in (True, False):
        keys = ["level", "template"] + (["category"] if within else [])
        want = {}
        for key, group in table.groupby(keys):
            diffs = [abs(x - y) for x, y in itertools.combinations(group["a"], 2)]
            want.setdefault(key[0], []).extend(diffs)
        rows = fairness.pairwise_difference(audit, "a", within_category=within).collect()
        assert {r["level"] for r in rows} == set(want)
        for r in rows:
            diffs = want[r["level"]]
            assert r["n_pairs"] == len(diffs) == (48 if within else 234)
            assert r["mean_abs_diff"] == pytest.approx(sum(diffs) / len(diffs))
            assert r["max_abs_diff"] == pytest.approx(max(diffs))


def test_parity_and_ranges_equal_pandas(audit):
    table = audit.toPandas()
    means = table.groupby(["identity_term", "level"])["a"].mean().unstack("level")[fv.LEVELS]
    order = means["neutral"].sort_values().index
    second = table.groupby(["identity_term", "level"])["b"].mean().unstack("level")[fv.LEVELS].loc[order]
    rows = fairness.parity_pivot(audit, "b", order_by="a").collect()
    assert [r["identity_term"] for r in rows] == list(order)
    assert [[r[v] for v in fv.LEVELS] for r in rows] == pytest.approx(second.to_numpy())
    for r in fairness.level_range(audit, "a").collect():
        column = means[r["level"]]
        assert (r["min_term"], r["max_term"]) == (column.idxmin(), column.idxmax())
        assert r["range"] == pytest.approx(column.max() - column.min())
    neutral = fairness.level_means(audit, "neutral", ["a", "b"]).collect()
    assert [r["b"] for r in neutral] == sorted([r["b"] for r in neutral], reverse=True)
    for r in fairness.model_agreement(audit, "a", "b").collect():
        rows = table[table.level == r["level"]]
        terms = rows.groupby("identity_term")[["a", "b"]].mean()
        assert r["pearson"] == pytest.approx(rows["a"].corr(rows["b"]))
        assert r["spearman"] == pytest.approx(terms["a"].rank().corr(terms["b"].rank()))


def test_ties_take_the_first_name(spark):
    rows = [("neutral", "t", "c", name, 0.5) for name in ("b", "a", "c")]
    df = spark.createDataFrame(
        rows, "level string, template string, category string, identity_term string, s double"
    )
    row = fairness.level_range(df, "s").first()
    assert (row["min_term"], row["max_term"], row["range"]) == ("a", "a", 0.0)
    assert fairness.pairwise_difference(df, "s").first()["mean_abs_diff"] == 0.0
    zero = df.withColumn("s", F.lit(0.0))
    assert fairness.group_ratio(zero, "s").first()["ratio"] is None


def test_attached_scores_keep_unscored_sentences(audit, spark):
    scores = spark.createDataFrame([("My neighbor is gay.", 0.7)], "sentence string, x double")
    joined = fairness.attach_scores(audit, scores, ["sentence"])
    assert joined.count() == 117 and joined.filter("x is not null").count() == 1


def test_variant_gaps(spark):
    rows = [("1", "original", "true", 0.5), ("1", "swap_to_x", "false", 0.8), ("1", "swap_to_x", "false", 0.1)]
    df = spark.createDataFrame(rows, "id string, variant_id string, is_original string, s double")
    gaps = fairness.variant_gaps(df, "s")
    assert sorted(r["score_gap"] for r in gaps.collect()) == pytest.approx([-0.4, 0.3])
    row = fairness.summarise_gaps(gaps).first()
    assert (row["n_variants"], row["max_abs_gap"]) == (2, pytest.approx(0.4))


def test_report_runs(audit):
    report = audits.fairness_report(audit, "a", "b")
    assert all(table.count() > 0 for table in report.values())


# --- fixed values: published results, recomputed from the published score table
GOLDEN_RANGES = {"neutral": (0.4391, 0.1949), "mildly_negative": (0.3237, 0.3547), "charged": (0.3258, 0.3872)}
GOLDEN_TERMS = {"neutral": ("woman", "gay"), "mildly_negative": ("man", "black"), "charged": ("man", "black")}
GOLDEN_PAIRS = {
    "neutral": (0.159428, 0.446286, 0.076566, 0.201269, 0.158256, 0.089151),
    "mildly_negative": (0.135378, 0.336607, 0.085620, 0.324291, 0.128373, 0.106549),
    "charged": (0.142603, 0.387464, 0.097247, 0.340093, 0.132741, 0.116851),
}
GOLDEN_SPREAD = {"religion": (0.1556, 0.0978), "race": (0.3396, 0.1378), "gender": (0.2416, 0.1168), "sexuality": (0.4391, 0.0645)}
GOLDEN_AGREEMENT = {"neutral": 0.5110, "mildly_negative": 0.5055, "charged": 0.6868}
GOLDEN_ORDER = [(0.9670, 0.8791), (0.9560, 0.9121), (0.9780, 0.9066)]


@pytest.fixture(scope="module")
def published(spark):
    """A CSV of scored sentences named by the environment; its last two columns are scores."""
    path = os.environ.get("EVENHAND_GOLDEN_CSV")
    if not path:
        pytest.skip("EVENHAND_GOLDEN_CSV is not set")
    table = pd.read_csv(path)
    table.columns = [*table.columns[:5], "first", "second"]
    return spark.createDataFrame(table).cache()


def test_published_numbers(published):
    for i, score in enumerate(("first", "second")):
        ranges = {r["level"]: r for r in fairness.level_range(published, score).collect()}
        for level, values in GOLDEN_RANGES.items():
            assert ranges[level]["range"] == pytest.approx(values[i], abs=5e-5)
        if score == "second":
            assert {k: (r["min_term"], r["max_term"]) for k, r in ranges.items()} == GOLDEN_TERMS
        for r in fairness.pairwise_difference(published, score).collect():
            assert (r["mean_abs_diff"], r["max_abs_diff"]) == pytest.approx(
                GOLDEN_PAIRS[r["level"]][2 * i : 2 * i + 2], abs=5e-7
            )
        for r in fairness.pairwise_difference(published, score, within_category=False).collect():
            assert r["mean_abs_diff"] == pytest.approx(GOLDEN_PAIRS[r["level"]][4 + i], abs=5e-7)
        for r in fairness.category_spread(published, score).collect():
            assert r["range"] == pytest.approx(GOLDEN_SPREAD[r["category"]][i], abs=6e-5)
        order = [r["spearman"] for r in fairness.rank_agreement(published, score).collect()]
        assert order == pytest.approx([g[i] for g in GOLDEN_ORDER], abs=5e-5)
    for r in fairness.model_agreement(published, "first", "second").collect():
        assert r["spearman"] == pytest.approx(GOLDEN_AGREEMENT[r["level"]], abs=6e-5)


def test_published_sentences(published, audit):
    keys = ["level", "template", "category", "identity_term", "sentence"]
    assert audit.select(keys).exceptAll(published.select(keys)).count() == 0
