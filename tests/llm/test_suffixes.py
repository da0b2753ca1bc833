import hashlib
import random
from collections import Counter

import pytest

from evenhand.llm import suffixes
from tests.llm.conftest import prose


def naive(rows):
    n = suffixes.LENGTH
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    counts = Counter(d[i : i + n] for _, d in data for i in range(len(d) - n + 1))
    out = []
    for doc_id, d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if counts[d[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((str(doc_id), len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    draw = random.Random(2)
    passage, long_passage = prose(1000, 60), prose(1001, 900)
    rows = []
    for i in range(40):
        text = prose(2000 + i, 80)
        at = draw.randrange(len(text))
        if i % 3 == 0:
            text = text[:at] + passage[draw.randrange(20) :] + text[at:]
        if i % 7 == 0:
            words = long_passage.split()
            words[draw.randrange(900)] = "changed"
            text += " ".join(words)
        rows.append((i, text))
    rows += [(100, "ab" * 400), (101, "x" * 199), (102, "y" * 200), (103, "z" * 201), (104, "ü" * 150)]
    rows += [(105, prose(5, 60) + "q" + prose(5, 60)), (106, rows[1][1]), (107, rows[1][1]), (107, rows[1][1])]
    shared = "s" + prose(7, 40)[:199]
    return rows + [(108, "A" + shared + "B"), (109, "C" + shared[:199] + "D"), (110, "E" + shared + "F")]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, odd_rows, small):
    if small:  # many chunks, blocks and parts
        monkeypatch.setattr(suffixes, "CHUNK", 300)
        monkeypatch.setattr(suffixes, "BLOCK_ROWS", 7)
        monkeypatch.setattr(suffixes, "PART_ROWS", 3)
    rows = corpus() + ([] if small else [r[:2] for r in odd_rows])
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(4)
    found = suffixes.remove_repeats(docs)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())
    assert got == naive(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found.filter("kept is not null").collect())


def test_empty_table(no_docs):
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_cover_reaches_every_pair_of_columns():
    cover = set(suffixes.COVER)
    for difference in range(suffixes.PERIOD):
        assert any((c + difference) % suffixes.PERIOD in cover for c in cover)
