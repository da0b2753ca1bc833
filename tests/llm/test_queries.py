import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from evenhand.llm import queries
from oracle_compare import connect, differences
from tests.llm.conftest import prose
from tests.llm.test_curriculum import filled
from tests.llm.test_decontamination import naive as naive_hits
from tests.llm.test_simhash import naive as naive_groups

WHOLE = {"op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"}


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in queries.QUERIES} == WHOLE
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    assert differences(spark, connect(sf_dir), name, queries.QUERIES[name], queries.ORACLES[name], sf_dir) == []


@pytest.mark.parametrize("name", ["op1_karmarkar_karp_shards", "op7_imatch_fingerprints", "op9_template_line_dedup"])
def test_every_document_has_a_row(spark, sf_dir, name):
    ids = [r.doc_id for r in queries.QUERIES[name](spark, sf_dir).collect()]
    assert sorted(ids) == list(range(200))


def brute_force(docs, items):
    """doc_ids (a row per pass) that reach the shards."""
    rows = [r for r in docs if "fool" not in r[1].split()]
    groups = {key[1]: component for key, _, component in naive_groups(rows)}
    rows = [r for r in rows if groups[r[0]] == r[0]]
    hit = {r[0]: r[-1] for r in naive_hits(rows, items)}
    rows = [r for r in rows if not hit[r[0]]]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    target, out = filled(sizes), []
    for source in sizes:
        own = [(hashlib.md5(f"{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), i, words(t)) for i, t, s in rows if s == source]
        full, rest = divmod(round(target[source]), sizes[source]) if sizes[source] else (0, 0)
        for _, i, n in sorted(own):
            out += [i] * (full * (n > 0) + (rest > 0))
            rest -= n
    return sorted(out)


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = [(i, prose(i, 30 + i % 40), f"s{i % 4}") for i in range(240)]
    docs = [(i, t + " fool" if i % 6 == 0 else t, s) for i, t, s in docs]
    docs += [(300 + i, docs[4 * i + 1][1], "s1") for i in range(20)]
    passage = prose(5000, 20)
    docs += [(400 + i, prose(600 + i, 30) + " " + passage, "s2") for i in range(5)]
    items = [(1, passage)]
    spark.createDataFrame([(*d, "en", len(d[1])) for d in docs], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240) if i % 3 != 1]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == brute_force(docs, items)
    sizes = [r.n for r in found.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 40 and max(sizes) < 3 * min(sizes)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixture", "shards"]


def written(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_with_odd_rows_and_empty_tables(spark, tmp_path, odd_rows):
    """Nulls in any column, empty and long texts, repeated rows, no labels, no benchmark, no rows."""
    docs = [(*r, None if i % 3 else "en", None) for i, r in enumerate(odd_rows)]
    found = corpus_pipeline.run(spark, written(spark, tmp_path / "a", docs, [], [(None, None), (1, "")])).collect()
    kept = {r.doc_id for r in found}
    assert 204 in kept and 5 in kept and kept <= {r[0] for r in odd_rows}
    assert not kept & {200, 201, 202, 203}  # without words they are never taken
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "b", [], [], [])).collect() == []


def test_pipeline_slots_follow_the_training_order(spark, tmp_path):
    docs = [(i, prose(i, 30 + i % 40), f"s{i % 4}", "en", 1) for i in range(200)]
    folder = written(spark, tmp_path, docs, [], [(1, prose(9000, 20))])
    mixed = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{stage.__name__}"
        stage(spark, mixed, folder).write.parquet(path)
        mixed = spark.read.parquet(path)
    files = sorted((tmp_path / "mix_sources").glob("part-*.parquet"))
    order = [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()]
    found = corpus_pipeline.shard_documents(spark, mixed, folder).collect()
    shard = {r.doc_id: r.shard for r in found}
    for number in set(shard.values()):
        own = sorted((r.slot, r.doc_id) for r in found if r.shard == number)
        assert [d for _, d in own] == [d for d in order if shard[d] == number]
