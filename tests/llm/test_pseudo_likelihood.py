from collections import Counter

import numpy as np
import pytest

from evenhand.llm import pseudo_likelihood as pl
from tests.llm.conftest import prose


def naive_score(w, classes):
    total = 0.0
    for i, target in enumerate(classes):
        hidden = w["b"].astype(float)
        for p, d in enumerate([-2, -1, 1, 2]):
            j = i + d
            hidden = hidden + w["E"][p][classes[j] if 0 <= j < len(classes) else pl.PAD]
        hidden = np.tanh(hidden)
        first, second = divmod(int(target), pl.HALF)
        one = hidden @ w["W1"] + w["c1"]
        two = (hidden + w["A"][first]) @ w["W2"] + w["c2"]
        total += one[first] - np.log(np.exp(one).sum()) + two[second] - np.log(np.exp(two).sum())
    return total


def test_gradient_is_the_slope():
    texts = [pl.token_classes(prose(1, 30)), pl.token_classes("one"), pl.token_classes("")]
    contexts, targets, number = pl.windows(texts)
    assert len(targets) == 31 and number.tolist() == [0] * 30 + [1]
    flat = pl.new_weights().astype(np.float64)
    g = pl.gradient(pl.views(flat), contexts, targets)
    draw = np.random.default_rng(1)
    hot = np.flatnonzero(np.abs(g) > 1e-4)
    for i in draw.choice(hot, 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        loss = lambda f: -pl.forward(pl.views(f), contexts, targets).mean()
        assert g[i] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=0.02, abs=1e-5)


def test_scores_against_brute_force(odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(pl, "STEP_TOKENS", 50)
    monkeypatch.setattr(pl, "CHUNK_BYTES", 400)
    weights = pl.new_weights(3)
    got = sorted((str(r.doc_id), r.n_tokens, r.log_prob) for r in pl.score(odd_docs, weights).collect())
    w = pl.views(weights)
    want = sorted((str(r[0]), len(c := pl.token_classes(r[1])), naive_score(w, c)) for r in odd_rows)
    assert [g[:2] for g in got] == [x[:2] for x in want]
    assert np.allclose([g[2] for g in got], [x[2] for x in want], rtol=1e-4)
    assert pl.pseudo_likelihood(no_docs).count() == 0


def test_training_beats_unigrams_on_held_out_text(spark, monkeypatch):
    """Word pairs: the second word follows from the first."""
    monkeypatch.setattr(pl, "FAN_IN", 2)
    monkeypatch.setattr(pl, "STEP_TOKENS", 256)
    import random

    def text(seed):
        draw = random.Random(seed)
        return " ".join(f"w{k} v{k}" for k in (draw.randrange(40) for _ in range(60)))

    docs = spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string").repartition(4)
    weights = pl.train(docs)
    test = spark.createDataFrame([(0, text(9999)), (1, " ".join(reversed(text(9999).split())))], "doc_id long, text string")
    good, bad = (r.per_token for r in pl.score(test, weights).orderBy("doc_id").collect())
    assert good > -np.log(80) + 1 and good > bad + 1


def naive_word_logs(corpus, text):
    """Sum of log P(word | class) with plain counters."""
    counts = Counter(w for t in corpus for w in (t or "").lower().split())
    own_class = {w: int(pl.token_classes(w)[0]) for w in [*counts, *(text or "").lower().split()]}
    n, kinds = Counter(), Counter()
    for w, k in counts.items():
        n[own_class[w]] += k
        kinds[own_class[w]] += 1
    total = 0.0
    for w in (text or "").lower().split():
        c = own_class[w]
        total += np.log((counts[w] + pl.UNSEEN) / (n[c] + pl.UNSEEN * (kinds[c] + 1)))
    return total


@pytest.mark.parametrize("hot, kept", [(1 << 20, 500_000), (40, 30), (1, 10)])
def test_word_scores_against_brute_force(odd_docs, odd_rows, monkeypatch, hot, kept):
    """All words hot, some, none; words forgotten on the way."""
    monkeypatch.setattr(pl, "HOT_WORDS", hot)
    monkeypatch.setattr(pl, "KEPT_WORDS", kept)
    monkeypatch.setattr(pl, "CHUNK_BYTES", 900)
    weights = pl.new_weights(3)
    rows = [r for r in odd_rows if r[0] != 205]  # str.split() knows more blanks than ASCII's
    docs = odd_docs.filter("doc_id is null or doc_id <> 205")
    words = pl.count_words(docs)
    assert {r["id"]: r["n"] for r in words.collect()} == {
        pl.word_id(w): k for w, k in Counter(w for r in rows for w in (r[1] or "").lower().split()).items()
    }
    got = sorted((str(r.doc_id), r.n_tokens, r.log_prob) for r in pl.score(docs, weights, words=words).collect())
    w, corpus = pl.views(weights), [r[1] for r in rows]
    want = sorted((str(r[0]), len(c := pl.token_classes(r[1])), naive_score(w, c) + naive_word_logs(corpus, r[1])) for r in rows)
    assert [g[:2] for g in got] == [x[:2] for x in want]
    assert np.allclose([g[2] for g in got], [x[2] for x in want], rtol=1e-4)


def test_a_rare_word_scores_lower_than_a_common_one_of_its_class(spark):
    common = "common"
    same = int(pl.token_classes(common)[0])
    rare, unseen = [f"w{i}" for i in range(20_000) if int(pl.token_classes(f"w{i}")[0]) == same][:2]
    docs = spark.createDataFrame([(i, f"a {common} b") for i in range(50)] + [(99, f"a {rare} b")], "doc_id long, text string")
    test = spark.createDataFrame([(0, f"a {common} b"), (1, f"a {rare} b"), (2, f"a {unseen} b")], "doc_id long, text string")
    found = pl.score(test, pl.new_weights(), words=pl.count_words(docs)).orderBy("doc_id").collect()
    first, second, third = (r.log_prob for r in found)
    assert first > second + 3 and second > third + 1
    plain = [r.log_prob for r in pl.score(test, pl.new_weights()).collect()]
    assert max(plain) - min(plain) < 1e-5  # the classes alone cannot tell them apart


def test_scores_of_an_empty_table(no_docs):
    assert pl.pseudo_likelihood(no_docs).collect() == []


def test_words_by_arrow_are_words_by_python():
    import pyarrow as pa

    texts = [None, "", "  ", " a\tB\x0bc\x1cd \r\n", "É É é", "x" * 9, "one One ONE two", "\n\nlast"]
    words, plain = pl.Words(), pl.Words()
    for start in (0, 3):
        got = pl._numbers(pa.array(texts)[start:], words)
        back = {n: w for w, n in words.items()}
        names = {n: w for w, n in plain.items()}
        for text, numbers in zip(texts[start:], got, strict=True):
            expected = plain.numbers(text)
            names.update({n: w for w, n in plain.items()})
            assert [back[n] for n in numbers] == [names[n] for n in expected]
