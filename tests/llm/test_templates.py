from collections import Counter, defaultdict

from evenhand.llm import templates as tp
from tests.llm.conftest import prose


def naive(rows, min_docs=None):
    """`min_docs` None: the registered rule, by the length of a line."""
    need = lambda t: min_docs or (tp.LONG_DOCS if len(t) >= tp.LONG_TOKENS else tp.MIN_DOCS)
    blank = " \t\r\f\x0b"

    def tokens(line):
        for c in blank:
            line = line.replace(c, " ")
        return tuple(tp.FIELD if any(d in t for d in "0123456789") else t for t in line.split(" ") if t)

    docs = [(i, (r[1] or "").split("\n") if r[1] is not None else []) for i, r in enumerate(rows)]
    leaf = lambda t: (len(t), t[: tp.DEPTH])
    by_leaf = defaultdict(set)
    for i, ls in docs:
        for line in ls:
            if tokens(line):
                by_leaf[leaf(tokens(line))].add(i)
    common = {k for k, v in by_leaf.items() if len(v) >= need(range(k[0]))}
    line_docs = defaultdict(set)
    for i, ls in docs:
        for line in ls:
            t = tokens(line)
            if t and leaf(t) in common:
                line_docs[t].add(i)
    seen = Counter()
    for t, own in line_docs.items():
        for place, token in enumerate(t):
            seen[leaf(t), place, token] += len(own)

    def template(t):
        fixed = tuple((p, x) for p, x in enumerate(t) if x != tp.FIELD and seen[leaf(t), p, x] >= need(t))
        return fixed if fixed and len(fixed) >= tp.FIXED_SHARE * len(t) else None

    uses = Counter()
    for t, own in line_docs.items():
        uses[leaf(t), template(t)] += len(own)
    out = []
    for (i, ls), r in zip(docs, rows):
        keep = [x for x in ls if not ((t := tokens(x)) and leaf(t) in common and template(t) and uses[leaf(t), template(t)] >= need(t))]
        out.append((str(r[0]), None if r[1] is None else "\n".join(keep), len(ls), len(ls) - len(keep)))
    return sorted(out, key=str)


def test_against_brute_force(spark, odd_rows, no_docs):
    rows = []
    for i in range(80):
        body = [prose(3000 + i * 7 + k, 9) for k in range(4)]
        if i % 2 == 0:
            body.insert(1, f"Posted by user{i} on day {i % 9} of the month in {['May', 'June', 'July'][i % 3]} again")
        if i % 3 == 0:
            body.append("All rights reserved by the owner of this page.")
        if i % 4 == 0:
            body.insert(0, f"Read more about {prose(i, 1)} here")
        rows.append((i, "\n".join(body) + ("\n\n" if i % 5 else "\r\n")))
    rows += [(90, rows[0][1]), (91, rows[0][1]), (None, rows[4][1])] + [r[:2] for r in odd_rows]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, places int").repartition(4)
    found = tp.drop_template_lines(docs, min_docs=6)
    got = sorted(((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=str)
    assert got == naive(rows, 6)
    assert sum(g[3] for g in got) > 80
    assert tp.drop_template_lines(no_docs).count() == 0


def test_long_lines_recur_from_two_documents_on(spark):
    long_line, short_line = prose(1, 60), prose(2, 12)
    texts = [f"{prose(50 + i, 60)}\n{long_line if i < 2 else prose(90 + i, 60)}\n{short_line}" for i in range(9)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in tp.drop_template_lines(rows).collect()}
    assert found == {i: t.replace(f"{long_line}\n", "") for i, t in enumerate(texts)}


def test_registered_rule_against_brute_force(spark):
    """Both classes of lines, exact and near copies, fields, odd blanks, copies of whole texts."""
    import random

    draw = random.Random(4)
    long_lines = [prose(700 + i, 24 + i % 3) for i in range(12)]
    rows = []
    for i in range(70):
        body = [prose(4000 + 9 * i + k, draw.choice([5, 12, 22, 40])) for k in range(3)]
        line = draw.choice(long_lines)
        if i % 3 == 0:
            words = line.split()
            if i % 2:
                words[draw.randrange(3, len(words))] = draw.choice(["changed", "other7", "<*>", "99"])
            body.insert(1, draw.choice(["", "  ", "\t"]) + " ".join(words).replace(" ", draw.choice([" ", "  ", " \t "]), 1))
        if i % 4 == 0:
            body += [f"Posted by user{i} on Monday", "1 2 3 4 five", "<*> <*> a", "short line of the site"]
        rows.append((i, "\n".join(body) + draw.choice(["", "\n", "\r\n"])))
    rows += [(200 + i, rows[i % 4][1]) for i in range(14)] + [(300, None), (301, ""), (302, "\n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = tp.drop_template_lines(docs)
    got = sorted(((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=str)
    assert got == naive(rows)
    assert sum(g[3] for g in got) > 60


def test_one_million_characters_without_a_blank(spark):
    """Linear work: no expression looks at a run again from each of its places."""
    import time

    long_text = ("letters" * 150_000)[:1_000_000]
    rows = [(0, long_text + "7"), (1, " " * 300_000 + "a"), (2, "7" * 500_000), (3, "a\n" * 20_000), (4, "\t " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.perf_counter()
    found = {r.doc_id: (r.text, r.n_dropped) for r in tp.drop_template_lines(docs).collect()}
    assert time.perf_counter() - start < 60
    assert {k: v[0] for k, v in found.items()} == dict(rows)
