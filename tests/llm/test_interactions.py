import random
import re
from itertools import permutations

import pytest
from pyspark.sql import Row

from evenhand.llm import interactions, queries
from evenhand.llm.interactions import difference, gallop, union


def test_galloping_against_sets():
    draw = random.Random(3)
    for _ in range(3000):
        top = draw.choice([5, 40, 300])
        lists = [sorted(draw.sample(range(top), draw.randrange(top))) for _ in range(draw.randrange(6))]
        assert union(lists) == sorted(set().union(*lists))
        if len(lists) > 1:
            a, b = lists[:2]
            assert difference(a, b) == sorted(set(a) - set(b))
            x, at = draw.randrange(top + 2), draw.randrange(len(a) + 1)
            assert gallop(a, x, at) == max(at, sum(v < x for v in a))


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        letter
        for letter, bad in {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
        }.items()
        if bad
    }


def naive(docs, labels):
    """Carries out every order, row by row."""
    least = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    good = {k for k, quality, _ in labels if k is not None and quality == 1}
    toxic = {k for k, _, bad in labels if k is not None and bad == 1}
    rows = {}
    for key, text, source in docs:
        own = fails(text or "") | ({"E"} if key is not None and key > least[text or ""] else set())
        rows.setdefault(source or "", []).append((key, own))
    out = {}
    for part, members in rows.items():
        over = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            kept = members
            for step, letter in enumerate(order, 1):
                gone = [r for r in kept if letter in r[1]]
                kept = [r for r in kept if letter not in r[1]]
                over[letter] += len(gone)
                out[part, "".join(order), step] = (
                    len(kept),
                    len(gone),
                    sum(letter in own for _, own in members) - len(gone),
                    sum(own == {letter} for _, own in members),
                    sum(k in good for k, _ in gone),
                    sum(k in toxic for k, _ in gone),
                )
        for (p, order, step), row in out.items():
            if p == part:
                out[p, order, step] = (*row[:6], over[order[step - 1]])
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_dict(found):
    rows = found.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


def labels_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string").repartition(3)


def test_odd_rows(spark, odd_docs, odd_rows):
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 240, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (9999, 1, 1), (204, None, 1)]
    frame = labels_frame(spark, [(k, q, int(t), "x") for k, q, t in labels])
    assert as_dict(interactions.interactions(odd_docs, frame)) == naive(odd_rows, [(k, q, int(t)) for k, q, t in labels])


def test_random_rows_over_several_ranges(spark):
    """Ids of many ranges, also negative ones, a hot text, rows that repeat, capitals and marks."""
    draw = random.Random(11)
    texts = ["", "Same words here", "# mark", "ONE TWO", *[" ".join(draw.choice("abcdefgh") + draw.choice(["", "x", "Y"]) for _ in range(draw.choice([3, 60, 80]))) for _ in range(25)]]
    texts += [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " $"]
    docs = [(draw.randrange(-20_000, 60_000), draw.choice(texts[: draw.choice([2, 40])]), draw.choice(["a", "b", None, ""])) for _ in range(900)]
    docs += docs[:40]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for k, _, _ in docs[::3]]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    found = interactions.interactions(frame, labels_frame(spark, [(*l, "x") for l in labels]))
    assert as_dict(found) == naive(docs, labels)


def test_empty_tables(spark, odd_docs, no_docs):
    none = labels_frame(spark, [])
    assert interactions.interactions(no_docs, none).collect() == []
    rows = interactions.interactions(odd_docs, none).where("good_lost > 0 or toxic_lost > 0").collect()
    assert rows == []


def test_every_order_of_every_part(spark, sf_dir):
    found = queries.op12_posting_list_audit(spark, sf_dir)
    parts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct().count()
    assert found.count() == parts * 600
    last = found.where("step = 5").groupBy("part").agg({"kept": "min"}).withColumnRenamed("min(kept)", "low")
    assert found.where("step = 5").join(last, "part").where("kept <> low").count() == 0


def test_texts_are_not_shuffled(spark, sf_dir):
    """What is dealt out holds a digest, not the text."""
    measured = interactions.measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert measured.columns == ["doc_id", "part", "bits", "digest"]
    assert isinstance(measured.first(), Row)


@pytest.mark.parametrize("raw, bits", [(b"", 1), (b"a\x0bb\x1cc", 1), ("É".encode() * 30, 1), (b"A" + b" b" * 60, 2), (b"#", 9)])
def test_failures(raw, bits):
    assert interactions.failures(raw) == bits
