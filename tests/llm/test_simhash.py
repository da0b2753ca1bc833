import itertools
import re

import numpy as np
import pytest
import xxhash

from evenhand.llm import simhash
from tests.llm.conftest import prose


def naive_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def naive(rows):
    prints = [naive_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0] is None, r[0] or 0), f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints)))


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in df.collect())


def test_whole_table_against_brute_force(odd_docs, odd_rows, no_docs):
    assert rows_of(simhash.near_duplicates(odd_docs)) == naive(odd_rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = prose(1, 500)
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == want == naive_print(text)


@pytest.mark.parametrize("anchor_rows", [8192, 16])
def test_every_link_is_found(spark, monkeypatch, anchor_rows):
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", anchor_rows)
    draw = np.random.default_rng(3)
    seeds = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(20):
            bits = draw.choice(64, draw.integers(1, 5), replace=False)
            prints.add(s ^ sum(1 << int(b) for b in bits))
    prints |= {0, 1, 3, 7, 15, 31, (1 << 64) - 1}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(6)
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    ours, theirs = {}, {}
    for p, s in zip(prints, signed):
        ours.setdefault(got.get(s, s), set()).add(p)
        theirs.setdefault(find(p), set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(24)], "a long, b long")
    got = simhash.components(edges).collect()
    assert len(got) == 24 and {r.root for r in got} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_one_of_each_group_stays(odd_docs, odd_rows, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    want, seen = [], set()
    for (null, i), _, component in naive(odd_rows):
        name = component if component is not None else (null, i, _)
        if name not in seen and (component is None or component == i and not null):
            seen.add(name)
            want.append((null, i))
    assert got == sorted(want)
    assert simhash.keep_one(no_docs).count() == 0
