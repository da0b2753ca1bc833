import hashlib
import re

import pytest

from evenhand.llm import decontamination as dc
from tests.llm.conftest import prose


def naive(docs, items):
    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(dc.WORD, t)

    windows = [(n, tuple(w[i : i + 10])) for n, t in items if (w := words(t)) for i in range(max(1, len(w) - 9))]
    out = []
    for doc_id, text, *_ in docs:
        w, hit, own = words(text), set(), set()
        for name, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    own |= {str(name)} if name is not None else set()
        ids = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(own), ids, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [4 << 20, 60])
def test_against_brute_force(spark, odd_docs, odd_rows, no_docs, block_bytes, monkeypatch):
    monkeypatch.setattr(dc, "SEGMENT", 7)
    monkeypatch.setattr(dc, "PIECE_WORDS", 8)
    items = [(1, " ".join(prose(9, 60).split()[5:25])), (2, "Cold, water!"), (3, None), (4, "a"), (5, "--"), (None, prose(7, 14))]
    items += [(6, prose(204, 30)), (6, prose(204, 30)), (7, "東京 \U0001f600"), (8, prose(3, 10)), (11, prose(3, 9))]
    benchmark = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, n int")
    found = dc.digest(dc.occurrences(odd_docs, benchmark, block_bytes=block_bytes))
    assert sorted((tuple(r) for r in found.collect()), key=str) == naive(odd_rows, items)
    clean = dc.clean_documents(odd_docs, benchmark, block_bytes=block_bytes)
    assert clean.columns == odd_docs.columns
    want = sorted(str(r[0]) for r in naive(odd_rows, items) if not r[-1])
    assert sorted(str(r.doc_id) for r in clean.collect()) == want
    assert dc.occurrences(no_docs, benchmark).count() == 0
    none = dc.digest(dc.occurrences(odd_docs, benchmark.limit(0)))
    assert none.filter("contaminated or n_items > 0").count() == 0 and none.count() == len(odd_rows)
    assert dc.clean_documents(odd_docs, benchmark.limit(0)).count() == len(odd_rows)
