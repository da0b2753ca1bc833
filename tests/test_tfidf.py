import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenhand.functions import bitmaps
from evenhand.operators import tfidf
from evenhand.plans import audits

DOCS = [
    "Common common rare don't", "", "the and of", "common words dont here", "common no\u00a0break dont",
    "words words words", "words again", None, "unique common",
]
COUNTS = [
    Counter(common=2, rare=1, dont=1), Counter(), Counter(), Counter(common=1, words=1, dont=1, here=1),
    Counter({"common": 1, "no": 1, "break": 1, "dont": 1}), Counter(words=3), Counter(words=1, again=1), Counter(), Counter(unique=1, common=1),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 2 else i / 10) for i, t in enumerate(DOCS)]
    return spark.createDataFrame(rows, "id long, comment_text string, target double").cache()


def brute(min_df=3):
    counts = COUNTS
    df = Counter(term for c in counts for term in c)
    n = len(DOCS)

    def idf(term):
        known = df[term] if df[term] >= min_df else 0
        return math.log((n + 1) / (known + 1)) + 1

    return counts, {t: d for t, d in df.items() if d >= min_df}, idf


def test_frequency_and_stats(docs):
    _, df, _ = brute()
    frequency = tfidf.document_frequency(docs)
    assert {r["term"]: r["df"] for r in frequency.collect()} == df
    assert tuple(tfidf.corpus_stats(docs, frequency).first()) == (len(DOCS), len(df))


@pytest.mark.parametrize("hot_terms", [4, 10_000])
def test_long_weights_equal_brute_force(docs, monkeypatch, hot_terms):
    original = tfidf.with_frequency
    monkeypatch.setattr(
        tfidf, "with_frequency", lambda p, f, k: original(p, f, k, hot_terms=hot_terms)
    )
    counts, df, idf = brute()
    want = {
        (i, t): c / sum(cs.values()) * idf(t)
        for i, cs in enumerate(counts) for t, c in cs.items() if t in df
    }
    got = {(r["id"], r["term"]): r["tfidf"] for r in tfidf.tfidf_long(docs).collect()}
    assert got == pytest.approx(want)


def test_vectors_hold_every_document(docs, spark):
    counts, df, idf = brute()
    rows = {r["id"]: r for r in tfidf.vectors(docs).collect()}
    assert len(rows) == len(DOCS)
    assert rows[1]["vec"] == {} and rows[2]["target"] == 0.0
    assert rows[3]["vec"] == pytest.approx(
        {t: c / 4 * idf(t) for t, c in counts[3].items() if t in df}
    )
    only = spark.createDataFrame([("words",)], "term string")
    restricted = {r["id"]: r["vec"] for r in tfidf.vectors(docs, vocabulary=only).collect()}
    assert set(restricted[5]) == {"words"} and restricted[0] == {}
    listed = {r["id"]: r["vec"] for r in tfidf.vectors(docs, vocabulary=["words"]).collect()}
    assert listed == restricted
    assert tfidf.tfidf_long(docs, vocabulary=[]).count() == tfidf.tfidf_long(docs).count()
    junk = docs.withColumn("target", F.lit("abc"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tfidf.vectors(junk).collect()


def test_term_frequencies_sum_to_one(docs):
    pairs = tfidf.term_counts(docs)
    sums = pairs.groupBy("id").agg(F.sum(tfidf.tf(F.col("cnt"), F.col("doc_len"))).alias("s"))
    assert [r["s"] for r in sums.collect()] == pytest.approx([1.0] * 6)


def test_lookup(docs, spark):
    counts, _, idf = brute()
    asked = [(0, "\tCommon\u00a0\n"), (0, "rare"), (0, "absent"), (1, "common"), (5, "WORDS"), (99, "common"), (0, "common")]
    requests = spark.createDataFrame(asked, "id long, term string")
    got = {(r["id"], r["term"]): r["tfidf"] for r in tfidf.lookup(requests, docs).collect()}
    assert got == pytest.approx(
        {
            (0, "common"): 2 / 4 * idf("common"),
            (0, "rare"): 1 / 4 * idf("rare"),  # a rare term counts with frequency 0
            (0, "absent"): 0.0,
            (1, "common"): 0.0,
            (5, "words"): idf("words"),
        }
    )
    assert [r["id"] for r in tfidf.missing_documents(requests, docs).collect()] == [99]


def test_top_terms_of_first_documents(docs):
    rows = audits.first_document_terms(docs, n=4, k=1).collect()
    assert {r["id"]: r["term"] for r in rows} == {0: "common", 3: "dont"}


@pytest.mark.parametrize("term", ["all", "longword" * 10])
def test_a_term_of_all_documents_is_spread(spark, term):
    """Its rows meet in the join by shuffle under as many keys as there are documents."""
    docs = spark.range(400).select("id", F.lit(f"{term} other").alias("comment_text"))
    frequency = tfidf.document_frequency(docs)
    pairs = tfidf.term_counts(docs).filter(F.col("term") == term)
    found = tfidf.with_frequency(pairs, frequency, "id")
    assert found.filter("df = 400").count() == 400
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(id" in plan and "pmod" not in plan


def test_labels_join_vectors_not_texts(spark, sf_dir):
    from evenhand.plans import workload

    plan = workload.tfidf_vectors(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and "text" in plan
    # every exchange below a join carries terms or ids: the text ends where it is cut into words
    physical = workload.tfidf_vectors(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for line in physical.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "comment_text" not in line


def test_bitmap_of_keys(spark):
    keys = spark.range(0, 4000, 7).withColumnRenamed("id", "key")
    found = bitmaps.bitmap(keys, "key", 1 << 16)
    assert found.count() <= 1 << 11
    every = spark.range(0, 40_000).withColumnRenamed("id", "key")
    kept = bitmaps.only_marked(every, "key", found, 1 << 16)
    assert kept.columns == ["key"]
    assert keys.join(kept, "key", "left_anti").count() == 0  # no key is lost
    assert kept.count() < 4000  # and few others pass
    texts = spark.createDataFrame([("a",), (None,), ("é",)], "key string")
    marks = bitmaps.marked(texts, "key", bitmaps.bitmap(texts, "key", 1 << 10), 1 << 10, "m")
    assert [r.m for r in marks.collect()] == [True] * 3
    nothing = bitmaps.bitmap(texts.limit(0), "key", 1 << 10)
    assert bitmaps.only_marked(texts, "key", nothing, 1 << 10).count() == 0


def test_texts_nobody_asked_for_are_not_shuffled(spark):
    """With Spark's own broadcasts off, the bitmap stands below the exchange of the texts."""
    docs = spark.range(500).selectExpr("id", "concat('word', id % 50, ' other') comment_text")
    asked = spark.createDataFrame([(3, "word3"), (4, "absent"), (900, "word1")], "id long, term string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = tfidf.lookup(asked, docs, min_df=1)
        assert sorted((r.id, r.term, r.tfidf > 0) for r in found.collect()) == [(3, "word3", True), (4, "absent", False)]
        kept = bitmaps.only_marked(docs, "id", bitmaps.bitmap(asked, "id", 1 << 20), 1 << 20)
        assert kept.count() < 20
        joined = kept.join(asked.select("id").distinct(), "id", "left_semi")
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("LeftSemi") < plan.index("getbit")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
