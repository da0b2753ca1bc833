import re

from pyspark.sql import functions as F

from evenhand.llm import curriculum


def filled(sizes, share=1.5, cap=2.0):
    """Targets by repeated resharing, as the contract states it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix(odd_docs, odd_rows, no_docs):
    rows = curriculum.mix(odd_docs, keep=["source"]).collect()
    assert len(rows) == len(odd_rows)
    sizes = {}
    for _, text, source in odd_rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = filled(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        source = r.row.source
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert curriculum.mix(no_docs).count() == 0
    again = curriculum.mix(odd_docs.repartition(3), keep=["source"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, s) for s in ("a", "b", "c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = curriculum.mix(df, weights=(1,), tilts=(0.5, 0.0, -0.5), share=1.0, keep=["source"])
    half = {r.s: r.n for r in found.filter("position < 0.5").groupBy(F.col("row.source").alias("s")).agg(F.count("*").alias("n")).collect()}
    # C(1/2) = 1/2 + tilt / 4 of the target
    assert abs(half["a"] - 187.5) < 2 and abs(half["b"] - 150) < 2 and abs(half["c"] - 112.5) < 2


def test_training_order_repeats_and_sorts(odd_docs, no_docs):
    mixed = curriculum.mix(odd_docs)
    passes = mixed.agg(F.sum("passes")).first()[0]
    ordered = curriculum.training_order(odd_docs)
    assert ordered.columns == odd_docs.columns and ordered.count() == passes
    assert curriculum.training_order(no_docs).count() == 0


def test_every_pass_is_inverted_and_documents_are_range_sorted(spark):
    """Two passes over every source: all draws of a document lie on the schedule, not the first only."""
    rows = [(i, "w " * (i % 7), s) for s in ("a", "b", None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = curriculum.mix(df, share=2.0, keep=["source"]).collect()
    tilt = {"a": 0.5, "b": 0.0, None: -0.5}
    places = {s: set() for s in tilt}
    for r in found:
        assert [(d["pass"], d["words"]) for d in r.draws] == ([(0, r.size), (1, r.size)] if r.size else [])
        assert r.taken == sum(d["words"] for d in r.draws) and r.passes == len(r.draws)
        for d in r.draws:
            t, k = d["position"], tilt[r.row.source]
            places[r.row.source].add((round(r.target * (t + k * (t - t * t)), 6), d["words"]))
    for drawn in places.values():  # draws follow each other without a gap, up to the target
        at = 0
        for start, words in sorted(drawn):
            assert abs(start - at) < 1e-5
            at += words
        assert abs(at - found[0].target) < 1e-6
    positions = [r.position for r in found if r.position is not None]
    assert positions == sorted(positions) and [r.position for r in found[len(positions):]] == [None] * sum(not r.size for r in found)
