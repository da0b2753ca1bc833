import random

from pyspark.sql import functions as F

from evenhand.llm import toxicity
from tests.llm.conftest import prose


def corpus(spark, n=400):
    draw, rows, labels = random.Random(5), [], []
    for i in range(n):
        words = prose(i, 60).split()
        threat, insult = i % 5 == 0, i % 5 == 0 or i % 7 == 0
        if threat:
            words.insert(draw.randrange(60), "crush")
        if insult:
            words.insert(draw.randrange(60), draw.choice(["fool", "Dunce!"]))
        rows.append((i, " ".join(words), 3))
        if i % 2 == 0:
            labels.append((i, int(insult), int(threat and insult)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fold int")
    return docs, spark.createDataFrame(labels, "doc_id long, insult int, threat int")


def test_held_out_accuracy_and_chain(spark):
    docs, labels = corpus(spark)
    found = toxicity.toxicity(docs, labels, ["insult", "threat"])
    wrong = [r for r in found.collect() if r.toxic != (r.doc_id % 5 == 0)]
    assert found.count() == 400 and len(wrong) <= 4
    chain = toxicity.fit(docs, labels, ["insult", "threat"])
    assert [m.numFeatures for m in chain.models] == [len(chain.vectors.vocabulary), len(chain.vectors.vocabulary) + 1]


def test_clean_documents_stay(spark):
    docs, labels = corpus(spark)
    kept = toxicity.clean_documents(docs, labels.withColumnRenamed("insult", "low_quality").withColumnRenamed("threat", "toxic"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len({i for i in range(400) if i % 5} - ids) <= 2 and len(ids & set(range(0, 400, 5))) <= 2


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 1), (3, 0, 0)], "doc_id long, low_quality int, toxic int")
    found = toxicity.toxicity(odd_docs, labels)
    assert found.count() == len(odd_rows) and found.filter(F.col("p_toxic").isNull()).count() == 0
    assert toxicity.toxicity(no_docs, labels).count() == 0
    none = toxicity.toxicity(odd_docs, labels.limit(0))
    assert none.filter("toxic or p_toxic > 0").count() == 0
