import hashlib
import re
import struct

import xxhash

from evenhand.llm import imatch
from tests.llm.conftest import prose


def expected(rows):
    """(doc_id, n_chars, edited hash) by walking the table in order."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    ordered = sorted(rows, key=key)
    out = []
    for i, r in enumerate(ordered):
        text, following = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        out.append((str(r[0]), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out)


def rows_of(found):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found)


def test_neighbours_and_edits(odd_docs, odd_rows, no_docs, monkeypatch):
    for slice_rows in (2_000, 9):
        monkeypatch.setattr(imatch, "SLICE_ROWS", slice_rows)
        found = imatch.fingerprint_pairs(odd_docs).collect()
        assert rows_of(found) == expected(odd_rows)
    by_text = {}
    texts = {r[0]: r[1] for r in odd_rows if r[0] is not None and r[0] != 5}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in texts:
            assert by_text.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert imatch.fingerprint_pairs(no_docs).count() == 0
    assert imatch.fingerprint_pairs(odd_docs.filter("doc_id = 7")).count() == 1


def test_hashes_by_hand(spark):
    rows = [(i, prose(i, 80)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = {r.term for r in imatch.lexicon(docs, low=0.1, high=0.6).collect()}
    texts = {i: set(t.split()) for i, t in rows}
    share = lambda w: sum(w in t for t in texts.values()) / 60
    assert lexicon == {w for t in texts.values() for w in t if 0.1 <= share(w) <= 0.6}


def test_likeness_tells_edits_from_strangers(spark, monkeypatch):
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "uvwxyzklmnopqr"]
    import random

    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(30))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(imatch.lexicon, "__defaults__", ("text", 0.02, 0.5, None))
    found = imatch.fingerprint_pairs(df).collect()
    edited = sum(r.near_edited for r in found) / 150
    assert edited > 0.2 and sum(r.near_next for r in found) / 150 < edited / 3


def test_whole_band_and_short_texts(spark):
    """A band of 5,000 terms stays whole; a text of two common terms has a print of its terms."""
    rows = [(i, " ".join(f"t{(i * 100 + k) % 5000}" for k in range(100)) + (" the and" if i % 2 else "")) for i in range(100)]
    docs = spark.createDataFrame([*rows, (100, "and the"), (101, "The: and!")], "doc_id long, text string")
    assert imatch.lexicon(docs).count() == 5000
    found = {r.doc_id: r.fingerprint for r in imatch.fingerprint_pairs(docs).collect()}
    assert found[100] == found[101] and not any(p.startswith("text:") for p in found.values())


def terms_of(text):
    return {w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower())}


def naive_print(text, band, above):
    """The fingerprint of a text from the two sets of terms, subset by subset."""

    def drawn(term, k, per_mille):
        h = xxhash.xxh64_intdigest(b"lexicon", xxhash.xxh64_intdigest(term.encode(), 42))
        own = xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)
        found = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<i", k), own)))[0]
        return found % 1000 < per_mille

    def parts(some, per_mille):
        out = []
        for k in range(imatch.SUBSETS):
            inside = [t for t in some if drawn(t, k, per_mille)]
            out.append(hashlib.md5(" ".join(inside).encode()).hexdigest()[:8] if inside else "-")
        return out

    own = terms_of(text)
    first = sorted(own & band)
    sparse = parts(first, imatch.PER_MILLE)
    if sum(p != "-" for p in sparse) >= imatch.SUBSETS // 2:
        return ".".join(sparse)
    dense = parts(first + sorted(own & above), imatch.DENSE_PER_MILLE)
    if {*sparse, *dense} == {"-"}:
        return "text:" + hashlib.md5(text.encode()).hexdigest()
    return ".".join(sparse) + "/" + ".".join(dense)


def naive_likeness(a, b):
    if a == b:
        return 1.0
    if a.startswith("text:") or b.startswith("text:"):
        return 0.0
    best = []
    for x, y in zip(a.split("/"), b.split("/")):
        pairs = [(p, q) for p, q in zip(x.split("."), y.split(".")) if (p, q) != ("-", "-")]
        best.append(sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0)
    return max(best)


def test_prints_and_likeness_against_brute_force(spark):
    """Whole texts of three kinds: rich, of few frequent terms, without any frequent term."""
    rows = [(i, " ".join(f"t{(i * 37 + k * k) % 2000}" for k in range(150)) + (" the and" if i % 2 else "")) for i in range(220)]
    rows += [(300, "the and"), (301, "The, the t5"), (302, "unheard"), (303, ""), (304, "t7 t7 and")]
    rows += [(400 + i, rows[i][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n, df = len(rows), {}
    for _, text in rows:
        for t in terms_of(text) - {""}:
            df[t] = df.get(t, 0) + 1
    frequent = {t for t, k in df.items() if k >= max(imatch.LOW * n, 2)}
    band = {t for t in frequent if df[t] <= imatch.HIGH * n}
    prints = {text: naive_print(text, band, frequent - band) for _, text in rows}
    found = sorted(imatch.fingerprint_pairs(docs).collect())
    kinds = set()
    for place, (r, (_, text)) in enumerate(zip(found, sorted(rows))):
        following = sorted(rows)[(place + 1) % n][1]
        cut = len(text) // 4
        edited = naive_print(text[: len(text) - cut] + following[:cut], band, frequent - band)
        assert (r.fingerprint, r.edited_fingerprint) == (prints[text], edited)
        assert abs(r.near_edited - naive_likeness(prints[text], edited)) < 1e-12
        assert abs(r.near_next - naive_likeness(prints[text], prints[following])) < 1e-12
        kinds.add("text:" in r.fingerprint or "/" in r.fingerprint)
    assert kinds == {True, False} and found[222].fingerprint.startswith("text:")
