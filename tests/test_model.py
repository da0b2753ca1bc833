import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from evenhand.operators import textmodel


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(200):
        text = " ".join(rng.choice(words, size=int(rng.integers(1, 12))))
        rows.append((i, text, float(("w3" in text.split()) * 0.6 + rng.random() * 0.2)))
    return spark.createDataFrame(rows, "id long, comment_text string, target double").cache()


def closed_form(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(0) @ w


@pytest.mark.parametrize("alpha", [1.0, 0.1])
def test_ridge_equals_closed_form(train, alpha):
    model = textmodel.fit(train, alpha=alpha, max_features=80)
    rows = PipelineModel(model.stages[:-1]).transform(train).select("features", "target").collect()
    x = np.array([r["features"].toArray() for r in rows])
    w, b = closed_form(x, np.array([r["target"] for r in rows]), alpha)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(w, abs=1e-6)
    assert model.stages[-1].intercept == pytest.approx(b, abs=1e-6)
    norms = np.linalg.norm(x, axis=1)
    assert ((np.abs(norms - 1) < 1e-9) | (norms == 0)).all()
    scored = textmodel.score(model, train).orderBy("id").collect()
    assert len(scored) == 200
    assert scored[0]["local_score"] == pytest.approx(float(x[0] @ w + b), abs=1e-5)


def test_features_equal_brute_force(train):
    docs = [r["comment_text"].split() for r in train.orderBy("id").collect()]
    grams = [d + [f"{a} {b}" for a, b in zip(d, d[1:])] for d in docs]
    tf, df = {}, {}
    for g in grams:
        for t in g:
            tf[t] = tf.get(t, 0) + 1
        for t in set(g):
            df[t] = df.get(t, 0) + 1
    kept = sorted(tf, key=lambda t: (-tf[t], t))[:50]
    got = textmodel.vocabulary(train, max_features=50).collect()
    assert [(r["term"], r["tf"], r["df"]) for r in got] == [(t, tf[t], df[t]) for t in kept]

    stages = textmodel.feature_stages(train, max_features=50)
    names = stages[1].vocabulary
    row = PipelineModel(stages).transform(train.filter("id = 7")).first()
    want = np.array(
        [grams[7].count(t) * (np.log((200 + 1) / (df[t] + 1)) + 1) for t in names]
    )
    assert row["features"].toArray() == pytest.approx(want / np.linalg.norm(want))
    assert [c for c in row.asDict() if c.startswith("__")] == []


def test_ridge_fails_without_convergence(train):
    rows = spark_rows(train)
    with pytest.raises(RuntimeError, match="no convergence"):
        textmodel.ridge(rows, 3, max_iterations=1)


def spark_rows(train):
    data = [([0, 1], [1.0, 2.0], 1.0), ([1, 2], [3.0, 1.0], 0.0), ([0, 2], [2.0, 5.0], 2.0), ([0], [1.0], 7.0)]
    return train.sparkSession.createDataFrame(data, "indices array<int>, values array<double>, label double")


def test_split_is_deterministic(train):
    tr, te = textmodel.split(train)
    _, again = textmodel.split(train.repartition(7))
    assert {r["id"] for r in te.collect()} == {r["id"] for r in again.collect()}
    assert tr.count() + te.count() == 200 and 20 < te.count() < 60


def test_coefficient_tables(train, tmp_path):
    model = textmodel.fit(train, max_features=60)
    coefs = textmodel.coefficients(model, train)
    top = textmodel.extreme_coefficients(coefs, 3).collect()
    assert len(top) == 6
    assert [r["feature"] for r in top if r["side"] == "higher"][0] == "w3"
    named = textmodel.identity_coefficients(coefs, {"g": ["w3", "nothing"], "h": ["W3"]}).collect()
    assert {(r["identity"], r["feature"]) for r in named} == {("g", "w3"), ("h", "w3")}
    model.save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    a = textmodel.score(model, train).agg(F.sum("local_score")).first()[0]
    assert textmodel.score(loaded, train).agg(F.sum("local_score")).first()[0] == pytest.approx(a)


@pytest.mark.parametrize("counters", [3, 20, 60, 1000])
def test_vocabulary_from_summaries_is_exact(spark, counters):
    """Few counters: terms are counted again, all of them where the floor is not above the error."""
    rng = np.random.default_rng(counters)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61) ** 1.5
    texts = [" ".join(rng.choice(words, size=int(rng.integers(0, 30)), p=share / share.sum())) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(999, None), (1000, "")], "id long, comment_text string").repartition(5)
    tf, df = {}, {}
    for t in texts:
        own = t.split()
        own += [f"{a} {b}" for a, b in zip(own, own[1:])]
        for x in own:
            tf[x] = tf.get(x, 0) + 1
        for x in set(own):
            df[x] = df.get(x, 0) + 1
    for size in (5, 40, 10_000):
        kept = sorted(tf, key=lambda x: (-tf[x], x))[:size]
        got = textmodel.vocabulary(docs, max_features=size, counters=counters).collect()
        assert [(r["term"], r["tf"], r["df"]) for r in got] == [(x, tf[x], df[x]) for x in kept]


def test_summaries_bound_their_error():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    lists = [[{"term": f"t{i}", "cnt": int(c)} for i, c in zip(rng.integers(0, 500, 40), rng.integers(1, 4, 40))] for _ in range(60)]
    kind = pa.list_(pa.struct([("term", pa.string()), ("cnt", pa.int64())]))
    true = {}
    for own in lists:
        for x in own:
            true[x["term"]] = true.get(x["term"], 0) + x["cnt"]
    batches = [pa.RecordBatch.from_arrays([pa.array([own], kind)], ["runs"]) for own in lists]
    rows = [r for b in textmodel._summary(batches, 30) for r in b.to_pylist()]
    error = sum(r["tf"] for r in rows if r["term"] is None)
    low = {r["term"]: r["tf"] for r in rows if r["term"] is not None}
    assert 0 < error <= sum(true.values()) / 30 and len(low) <= 120
    assert all(low.get(t, 0) <= n <= low.get(t, 0) + error for t, n in true.items())


def sparse_rows(spark, n, features, parts):
    rng = np.random.default_rng(2)
    data, dense, labels = [], np.zeros((n, features)), rng.random(n)
    for i in range(n):
        own = sorted(rng.choice(features, size=int(rng.integers(0, 6)), replace=False).tolist())
        values = rng.random(len(own)).tolist()
        dense[i, own] = values
        data.append((own, values, float(labels[i])))
    rows = spark.createDataFrame(data, "indices array<int>, values array<double>, label double").repartition(parts)
    return rows.persist(), dense, labels


def test_tree_of_partial_vectors(spark, monkeypatch):
    """Several levels of the tree and several blocks, the last one short; no block of zeros."""
    monkeypatch.setattr(textmodel, "FAN_IN", 3)
    monkeypatch.setattr(textmodel, "BLOCK", 4)
    rows, dense, labels = sparse_rows(spark, 200, 18, 23)
    n, mean, parts = textmodel._head(rows)
    assert (n, parts) == (200, 23) and mean == pytest.approx(labels.mean())

    def sums(batches):
        out = np.zeros(18)
        for batch in batches:
            _, indices, values, _ = textmodel._row_lists(batch)
            out += np.bincount(indices, values, 18)
        return out

    for n_parts in (23, 1, 500):  # the number only shapes the tree
        assert textmodel.total(rows, n_parts, 18, sums) == pytest.approx(dense.sum(axis=0))
    exact, steps = textmodel.normal_equations(rows, 18), textmodel.ridge(rows, 18, tolerance=1e-12)
    w, b = closed_form(dense, labels, 1.0)
    for found in (exact, steps):
        assert found.coefs == pytest.approx(w, abs=1e-9) and found.intercept == pytest.approx(b, abs=1e-9)
    assert exact.passes == 2 and 4 <= steps.passes <= 22
    with pytest.raises(ValueError, match="too large a matrix"):
        textmodel.normal_equations(rows, textmodel.DENSE_FEATURES + 1)
    with pytest.raises(ValueError, match="no rows"):
        textmodel.ridge(rows.filter("label > 2"), 18)


def test_closed_form_pipeline_and_positions(train):
    small, large = (textmodel.fit(train, max_features=12, closed_form=c) for c in (True, False))
    coefs = textmodel.coefficients(small, train)
    by_name = [{r["feature"]: r["coef"] for r in textmodel.coefficients(m, train).collect()} for m in (small, large)]
    assert len(by_name[0]) == 12 and by_name[0] == pytest.approx(by_name[1], abs=1e-5)
    rows = textmodel.extreme_coefficients(coefs, 3).collect()
    assert [(r["side"], r["position"]) for r in rows] == [(s, i) for s in ("higher", "lower") for i in (1, 2, 3)]
    ordered = sorted(((r["coef"], r["feature"]) for r in coefs.collect()), reverse=True)
    assert [r["feature"] for r in rows[:3]] == [f for _, f in ordered[:3]]
    ties = train.sparkSession.createDataFrame([("b", 0.1), ("a", 0.1 + 1e-13), ("c", 0.3)], "feature string, coef double")
    assert [r["feature"] for r in textmodel.extreme_coefficients(ties, 3).collect()] == ["c", "a", "b", "a", "b", "c"]


def test_summaries_get_single_runs(spark, monkeypatch):
    """However long the documents are, a batch holds so many runs as Spark puts rows into one."""

    def summary(batches, counters):
        import pyarrow as pa

        for batch in batches:
            held = batch.column(0)
            n = len(held.flatten() if pa.types.is_list(held.type) else held)
            assert n <= 10_000, f"{n} runs at once"
            yield from textmodel_summary([batch], counters)

    textmodel_summary = textmodel._summary
    monkeypatch.setattr(textmodel, "_summary", summary)
    texts = [" ".join(f"d{d % 20}w{i}" for i in range(400)) for d in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, comment_text string").coalesce(1)
    found = textmodel.vocabulary(docs, max_features=50_000)
    assert found.count() == 20 * (400 + 399) and {(r["tf"], r["df"]) for r in found.collect()} == {(2, 2)}


def test_solvers_work_on_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(textmodel, "ENTRIES", 12)
    monkeypatch.setattr(textmodel, "DENSE_ROWS", 2)
    rows, dense, labels = sparse_rows(spark, 150, 120, 3)
    blocks = textmodel.packed(rows)
    found = blocks.select(F.sum("n"), F.sum("label_sum"), F.max(F.length("values") / 8), F.count("*")).first()
    assert found[0] == 150 and found[1] == pytest.approx(labels.sum()) and found[2] <= 12 and found[3] > 20
    w, b = closed_form(dense, labels, 1.0)
    for solution in (textmodel.normal_equations(rows, 120), textmodel.ridge(rows, 120, tolerance=1e-12)):
        assert solution.coefs == pytest.approx(w, abs=1e-9) and solution.intercept == pytest.approx(b, abs=1e-9)


def test_ridge_does_not_repeat_steps(spark):
    """24 unknowns take 24 steps, however far the eigenvalues lie apart; rounding errors made it 132."""
    rng = np.random.default_rng(4)
    mix = rng.random((4, 24)) * 10.0 ** np.array([2, 1, 0, -1])[:, None]
    x = rng.random((90, 4)) @ mix + 10.0 ** -rng.integers(0, 4, 24) * rng.random((90, 24))
    y = rng.random(90)
    data = [(list(range(24)), row.tolist(), float(label)) for row, label in zip(x, y)]
    rows = spark.createDataFrame(data, "indices array<int>, values array<double>, label double").repartition(3)
    found = textmodel.ridge(rows, 24, alpha=1e-3, tolerance=1e-9)
    w, b = closed_form(x, y, 1e-3)
    assert found.passes <= 28
    assert found.coefs == pytest.approx(w, abs=1e-5) and found.intercept == pytest.approx(b, abs=1e-4)


def test_solver_passes_take_as_many_tasks_as_cores_need(spark, monkeypatch):
    """Partitions beyond that are read together, some of them empty, and no row is lost."""
    seen, added = [], textmodel._added

    def counted(blocks, partial):
        seen.append(blocks.getNumPartitions())
        return added(blocks, partial)

    monkeypatch.setattr(textmodel, "_added", counted)
    rows, dense, labels = sparse_rows(spark, 60, 18, 30)
    for per_core, fan_in in ((1, 32), (3, 2)):  # 4 tasks; 12 and a tree of several levels
        monkeypatch.setattr(textmodel, "TASKS_PER_CORE", per_core)
        monkeypatch.setattr(textmodel, "FAN_IN", fan_in)
        found = textmodel.ridge(rows, 18, tolerance=1e-12)
        assert found.coefs == pytest.approx(closed_form(dense, labels, 1.0)[0], abs=1e-9)
        assert set(seen) == {4 * per_core}
        seen.clear()


@pytest.mark.parametrize("words_at_once", [1, 7, 250_000])
def test_term_counts_equal_brute_force(monkeypatch, words_at_once):
    """Repeated words, words of other scripts, no words, null; pairs never cross documents."""
    import pyarrow as pa

    monkeypatch.setattr(textmodel, "WORDS", words_at_once)
    docs = [["ab", "ab", "ab"], [], None, ["über"], ["ab", "über", "ab", "über"], ["x1", "_y"], ["ab", "ab"]]
    whole = pa.RecordBatch.from_arrays([pa.array(docs, pa.list_(pa.string()))], ["tokens"])
    tf, df = {}, {}
    for d in docs[1:]:
        own = (d or []) + [f"{a} {b}" for a, b in zip(d or [], (d or [])[1:])]
        for x in own:
            tf[x] = tf.get(x, 0) + 1
        for x in set(own):
            df[x] = df.get(x, 0) + 1
    found = [r for t in textmodel._term_counts([whole.slice(1, 3), whole.slice(4), whole.slice(0, 0)]) for r in t.to_pylist()]
    got = {t: tuple(sum(r[c] for r in found if r["term"] == t) for c in ("tf", "df")) for t in {r["term"] for r in found}}
    assert got == {t: (tf[t], df[t]) for t in tf}
    runs = [r for b in textmodel._runs([whole.slice(1)]) for r in b.column(0).to_pylist()]
    assert {r["term"]: 0 for r in runs}.keys() == tf.keys() and sum(r["cnt"] for r in runs) == sum(tf.values())


def test_rank_search_reads_terms_that_can_belong_only(spark, monkeypatch):
    seen, last_term = [], textmodel._last_term

    def counted(terms, max_features):
        seen.append(terms.count())
        return last_term(terms, max_features)

    monkeypatch.setattr(textmodel, "_last_term", counted)
    texts = [" ".join(f"w{i}" for i in range(k)) for k in range(1, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, comment_text string")
    found = textmodel.vocabulary(docs, max_features=4).collect()
    assert [(r["term"], r["tf"], r["df"]) for r in found] == [("w0", 39, 39), ("w0 w1", 38, 38), ("w1", 38, 38), ("w1 w2", 37, 37)]
    assert seen == [5]  # of 77 terms: w2 has 37, too
    assert textmodel.vocabulary(docs, max_features=77).count() == 77 == textmodel.vocabulary(docs, max_features=99).count()


def test_optimality_reads_the_rows_once(train):
    model = textmodel.fit(train, max_features=60)
    extra = train.sparkSession.createDataFrame([(900, "nothing known", 0.7), (901, "", 0.1), (902, "w3", None)], train.schema)
    rows, read = train.union(extra), train.sparkSession.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = textmodel.optimality(model, rows.mapInArrow(counted, rows.schema)).first()
    assert read.value == 203
    got = textmodel.score(model, rows.dropna()).collect()
    assert found["mean_residual"] == pytest.approx(np.mean([r["local_score"] - r["target"] for r in got]))
    x = np.array([r["features"].toArray() for r in PipelineModel(model.stages[:-1]).transform(rows.dropna()).collect()])
    residual = np.array([r["local_score"] - r["target"] for r in got])
    gradient = x.T @ residual + model.stages[-1].coefficients.toArray()
    assert found["largest_gradient"] == pytest.approx(np.abs(gradient).max()) and found["unit_vectors"] == 1.0
    doubled = textmodel.optimality(model, train.filter("id < 0")).first()
    assert doubled["mean_residual"] is None and doubled["unit_vectors"] is None
