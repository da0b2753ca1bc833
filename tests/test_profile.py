import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenhand.operators import profile
from evenhand.operators.mentions import mention_array, mention_rows

NAN = float("nan")


def scores(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "s double")


def test_bands_are_right_closed_and_keep_empty_ones(spark):
    df = scores(spark, [0.0, 0.2, 0.2000001, 0.5, 0.8, 1.0, 1.2, None, NAN])
    got = [r["n"] for r in profile.band_counts(df, "s").orderBy("band_pos").collect()]
    assert got == [1, 2, 1, 1]
    assert [r["n"] for r in profile.band_counts(scores(spark, [0.1]), "s").collect()] == [1, 0, 0, 0]


@pytest.mark.parametrize("sortable", [200_000, 3])
def test_describe_equals_pandas(spark, sortable):
    values = [0.0, 0.1, 0.4, 0.9, None, NAN] + [0.25] * 40 + [i / 7 for i in range(30)]
    row = profile.describe(scores(spark, values), "s", sortable).first()
    want = pd.Series([v for v in values if v is not None]).describe()
    assert list(row) == pytest.approx(list(want))


def test_describe_small_and_empty(spark):
    row = profile.describe(scores(spark, [0, 0.1, 0.4, 0.9, None]), "s").first()
    assert (row["n"], row["mean"]) == (4, pytest.approx(0.35))
    assert (row["p25"], row["p50"], row["p75"]) == pytest.approx((0.075, 0.25, 0.525))
    assert profile.describe(scores(spark, [None]), "s").first()["n"] == 0


@pytest.mark.parametrize(
    "values", [[i / 100 for i in range(101)], [0.3], [0.1, 0.2, 0.7], [i * 0.1 for i in range(-5, 40)]]
)
def test_histogram_equals_numpy(spark, values):
    rows = profile.histogram(scores(spark, values + [None, NAN]), "s", 50).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=50)
    assert [r["n"] for r in rows] == list(counts)
    assert [r["bin_lo"] for r in rows] == pytest.approx(list(edges[:-1]))
    assert rows[-1]["bin_hi"] == pytest.approx(edges[-1])
    assert profile.histogram(scores(spark, [None]), "s").count() == 0


def test_identity_summary(spark):
    rows = [(1.0, 0.4, 0.9), (0.5, 0.0, None), (NAN, 0.6, 0.5), (0.4, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, target double")
    got = profile.identity_summary(df, ["a", "b", "absent"], "target", min_group_size=1).collect()
    table = {r["identity"]: (r["n_comments"], r["mean_toxicity"], r["pct_toxic"]) for r in got}
    # the mean skips the missing score, the percentage divides by both rows
    assert table == {"a": (2, 0.9, 50.0), "b": (1, 0.5, 100.0)}
    assert [r["identity"] for r in got] == ["a", "b"]
    assert profile.identity_summary(df, ["a", "b"], "target", min_group_size=2).count() == 1


def test_mentions_keep_order_and_accept_text(spark):
    df = spark.createDataFrame(
        [(1, "0.5", 1.0), (2, "x", 0.2), (3, "", NAN), (4, " 0.9", None)], "id int, g1 string, g2 double"
    )
    got = {r["id"]: r["mentions"] for r in mention_rows(df, ["g2", "g1", "gone"]).collect()}
    assert got == {1: ["g2", "g1"], 4: ["g1"]}
    assert df.select(mention_array(df, ["gone"])).first()[0] == []


def test_mention_filter_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "wide")
    rows = [(1, 0.9, NAN, "x"), (2, 0.1, 0.2, "y"), (3, None, 0.5, "z"), (4, NAN, NAN, "w")]
    spark.createDataFrame(rows, "id int, a double, b double, t string").write.parquet(path)
    df = mention_rows(spark.read.parquet(path), ["a", "b"]).select("id", "mentions")
    assert {r["id"]: r["mentions"] for r in df.collect()} == {1: ["a"], 3: ["b"]}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Or(GreaterThanOrEqual(a,0.5),GreaterThanOrEqual(b,0.5))" in plan
    assert "ReadSchema: struct<id:int,a:double,b:double>" in plan


def test_band_samples_are_members_and_stable(spark):
    rows = [(i, i / 100, 1.0, float(i % 2), f"text\n{i}") for i in range(101)] + [(999, 0.1, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, t double, a double, b double, c string")
    got = profile.band_samples(df, ["a", "b"], "t", "c", "id").collect()
    again = profile.band_samples(df.repartition(7), ["a", "b"], "t", "c", "id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert len(got) == 6
    bounds = {"LOW": (0, 0.2), "MID": (0.3, 0.6), "HIGH": (0.7, 1.0)}
    for r in got:
        low, high = bounds[r["band"]]
        assert low <= r["score"] < high
        assert r["identity"] == "a" or r["id"] % 2 == 1
        assert r["preview"] == f"text {r['id']}"


def test_row_audit(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "x int, y string")
    row = profile.row_audit(df, ["x", "y"], F.col("x") > 1).first()
    assert tuple(row) == (3, 1, 2, 1)
    assert profile.drop_missing(df, ["x", "y"]).count() == 1
