import re

import pytest

import __spark_entry__ as contract
from oracle_compare import connect, differences

from evenhand.plans.oracles import ORACLES
from evenhand.plans.workload import QUERIES

PYTHON_NODES = re.compile(r"BatchEvalPython|ArrowEvalPython|MapInArrow|MapInPandas|CartesianProduct")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    # these hold coefficients of the solved system; model_optimality checks the solution
    assert set(QUERIES) - set(ORACLES) == {"model_scores", "model_top_terms", "model_identity_coefs"}


def test_extreme_coefficients_are_ordered(spark, sf_dir):
    rows = QUERIES["model_top_terms"](spark, sf_dir).collect()
    for side, sign in (("higher", -1), ("lower", 1)):
        own = [sign * r["coef"] for r in rows if r["side"] == side]
        assert len(own) == 20 and own == sorted(own)


def test_entry(spark, sf_dir):
    assert contract.entry(spark).count() > 0


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, connection, name):
    assert differences(spark, connection, name, QUERIES[name], ORACLES[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    assert not PYTHON_NODES.search(plan(df))


@pytest.mark.parametrize(
    "name", ["eda_identity_toxicity", "strata_rows", "counterfactual_variants", "tfidf_long", "sentence_grid", "pairwise_difference", "variant_score_gaps", "tfidf_top3"],
)
def test_plans_stay_native_and_partitioned(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not PYTHON_NODES.search(text)
    assert "BroadcastNestedLoopJoin" not in text
    for window in re.findall(r"Window \[.*", text):
        assert "], []" not in window  # no window over an unpartitioned table


def test_scans_are_pruned(spark, sf_dir):
    text = plan(QUERIES["train_test_split"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint>" in text
    text = plan(QUERIES["doc_frequency"](spark, sf_dir))
    assert "ReadSchema: struct<text:string>" in text


def test_common_terms_are_salted_in_the_shuffle_join(spark, sf_dir):
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in settings:
        spark.conf.set(name, "-1")
    try:
        df = QUERIES["tfidf_long"](spark, sf_dir)
        assert re.search(r"SortMergeJoin \[lookup#\d+\], \[lookup#\d+\], LeftOuter", plan(df))
    finally:
        for name in settings:
            spark.conf.unset(name)
