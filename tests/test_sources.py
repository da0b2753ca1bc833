import csv

import pytest
from pyspark.sql import functions as F

from evenhand.operators import fairness
from evenhand.plans import audits
from evenhand.sources import comments as src
from evenhand.sources import sinks

ROWS = [
    {"id": "1", "comment_text": 'A "quoted"\nman, here', "toxicity": "0.9", "male": "1.0", "female": ""},
    {"id": "2", "comment_text": "A woman", "toxicity": "", "male": "junk", "female": "0.5"},
    {"id": "3", "comment_text": "A boy", "toxicity": "bad", "male": "0.7", "female": "0"},
    {"id": "4", "comment_text": "Nobody", "toxicity": "0.2", "male": "0.4", "female": "0.4"},
]


@pytest.fixture()
def csv_path(tmp_path):
    path = tmp_path / "in.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, fieldnames=list(ROWS[0]))
        writer.writeheader()
        writer.writerows(ROWS)
    return str(path)


def test_csv_rows_are_text_and_multiline(spark, csv_path):
    rows = src.csv_rows(spark, csv_path).orderBy("id").collect()
    assert [r["comment_text"] for r in rows] == [r["comment_text"] for r in ROWS]
    assert src.csv_rows(spark, csv_path, ["id"]).columns == ["id"]


def test_typed_comments(spark, csv_path):
    df = src.comments(src.csv_rows(spark, csv_path), ["male", "female", "absent"], "toxicity")
    got = {r["id"]: (r["target"], r["male"], r["female"]) for r in df.collect()}
    assert got["1"] == (0.9, 1.0, None)
    assert got["2"] == (None, None, 0.5)
    assert got["3"][0] is None
    with pytest.raises(ValueError, match="no score column"):
        src.comments(src.csv_rows(spark, csv_path), [], "target")


def test_bias_audit_writes_one_folder_per_stratum(spark, csv_path, tmp_path):
    out = str(tmp_path / "out")
    audits.bias_audit(src.csv_rows(spark, csv_path), out, top_n=1, middle_n=0, bottom_n=1)
    back = src.csv_rows(spark, out)
    got = {(r["stratum"], r["id"], r["variant_id"], r["variant_text"], r["is_original"]) for r in back.collect()}
    # row 3 has an unparsable score and is dropped, row 2 has none and counts as 0
    assert got == {
        ("top", "1", "original", 'A "quoted"\nman, here', "true"),
        ("top", "1", "swap_to_female", 'A "quoted"\nwoman, here', "false"),
        ("bottom", "2", "original", "A woman", "true"),
        ("bottom", "2", "swap_to_male", "A man", "false"),
    }
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"stratum=top", "stratum=bottom"}


def test_external_scores_round_trip(spark, csv_path, tmp_path):
    variants = audits.stratified_variants(src.csv_rows(spark, csv_path))
    scored = variants.select("id", "variant_id", F.length("variant_text").cast("string").alias("s")).distinct()
    sinks.write_table(scored, str(tmp_path / "scores"), "csv")
    scores = src.external_scores(spark, str(tmp_path / "scores"), ["id", "variant_id"], "s")
    joined = fairness.attach_scores(variants.filter("stratum = 'top'"), scores, ["id", "variant_id"])
    gaps = {r["id"]: r["score_gap"] for r in fairness.variant_gaps(joined, "s").collect()}
    assert gaps == {"1": 2.0, "2": -2.0}


def test_file_order(spark, tmp_path):
    path = str(tmp_path / "many")
    sinks.write_table(spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id"), path)
    df = src.with_file_order(spark.read.parquet(path))
    assert df.filter("id <> doc_index").count() == 0 and df.count() == 1000


def test_indexed_comments(spark, csv_path, tmp_path):
    got = [tuple(r) for r in src.indexed_comments(spark, csv_path).orderBy("doc_index").collect()]
    assert got[1] == (1, "A woman", "0")
    assert [g[0] for g in got] == [0, 1, 2, 3]


def test_parquet_conversion(spark, csv_path, tmp_path):
    src.to_parquet(src.csv_rows(spark, csv_path), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_exploration_and_fairness_audit(spark):
    rows = [
        (i, f"word{i % 7} man {'bad' if i % 3 == 0 else 'good'} text", float(i % 3 == 0), 1.0, float(i % 2))
        for i in range(120)
    ]
    df = spark.createDataFrame(
        rows, "id long, comment_text string, target double, male double, female double"
    )
    tables = audits.identity_exploration(df, ["male", "female"], ["male"])
    assert tables["rows"].first()["n_rows"] == 120
    assert tables["identities"].count() == 2
    assert tables["samples"].count() == 1  # only scores 0 and 1: LOW holds 0, 1 is never sampled
    scores = spark.createDataFrame([("My neighbor is gay.", 0.4)], "sentence string, external_score double")
    model, audit = audits.fairness_audit(df, scores=scores, max_features=100)
    assert audit.count() == 117
    assert audit.filter("local_score is null").count() == 0
    assert audit.filter("external_score is not null").count() == 1


def test_csv_sink_keeps_white_space_and_quotes(spark, tmp_path):
    from evenhand.sources import sinks

    texts = ["  lead and trail \t", '"quoted" "', "line\nbreak ", " ", "a,b", "\ttab"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, comment_text string")
    sinks.write_table(df, str(tmp_path / "t"), "csv")
    back = {r["id"]: r["comment_text"] for r in src.csv_rows(spark, str(tmp_path / "t")).collect()}
    assert back == {str(i): t for i, t in enumerate(texts)}


def test_rows_without_a_score_go_out_again(spark):
    variants = spark.createDataFrame([("1", "a", "x"), ("1", "b", "y"), ("2", "a", "z")], "id string, variant_id string, t string")
    scores = spark.createDataFrame([("1", "a", 0.5), ("1", "a", 0.6), ("2", "a", None)], "id string, variant_id string, s double")
    left = src.unscored(variants, scores, ["id", "variant_id"])
    assert sorted((r["id"], r["variant_id"]) for r in left.collect()) == [("1", "b"), ("2", "a")]
    assert left.columns == ["id", "variant_id", "t"]


def test_folder_names_with_escapes(spark, tmp_path):
    values = ["plain", "a b", "50%", "x=y/z", "é+ü", None]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, stratum string")
    df.write.partitionBy("stratum").option("header", True).csv(str(tmp_path / "t"))
    for whole in (False, True):
        got = {r["id"]: r["stratum"] for r in src.csv_rows(spark, str(tmp_path / "t"), whole_files=whole).collect()}
        assert got == {str(i): v for i, v in enumerate(values)}


def test_a_cluster_needs_a_shared_folder(spark):
    from evenhand.sources import shared

    class Cluster:
        def __init__(self, master, folder=None):
            self.sparkContext = type("C", (), {"master": master})
            values = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "/w"}
            self.conf = type("F", (), {"get": staticmethod(lambda key, default=None: values[key] or default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_root(Cluster("spark://host:7077"))
    assert shared.shared_root(Cluster("spark://host:7077", "hdfs://x")) == "hdfs://x"
    assert shared.shared_root(Cluster("local[2]")) == "/w/_shared"
    assert shared.new_folder(spark, "a") != shared.new_folder(spark, "a")
