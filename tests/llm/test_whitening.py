from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from evenhand.llm import queries, whitening
from evenhand.llm.whitening import Centre, eigenvalues_above, leading_eigenpairs


def rotated(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    found = q @ np.diag(values) @ q.T
    return (found + found.T) / 2


CASES = {
    "random": rotated(np.random.default_rng(1).random(40) * 100),
    "identity": np.eye(40),
    "equal values": rotated([100.0] * 5 + [3.0] * 10 + [1.0] * 25),
    "five only": rotated([100.0] * 5 + [0.0] * 35),
    "one large": rotated([1e6, *(1 + 1e-13 * np.arange(39))]),
    "falling": rotated(3.0 ** -np.arange(40)),
    "one": np.array([[4.0]]),
}


@pytest.mark.parametrize("name", CASES)
def test_eigenpairs_against_numpy(name):
    matrix = CASES[name]
    values, vectors = leading_eigenpairs(matrix, 32)
    known = np.linalg.eigvalsh(matrix)[::-1]
    assert len(values) == min(32, int((known > 16 * 2.3e-16 * len(matrix) * known[0]).sum()))
    assert np.abs(values - known[: len(values)]).max() < 1e-12 * known[0]
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * known[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_counts_of_indefinite_matrices():
    draw = np.random.default_rng(2)
    for size in (2, 3, 8, 30):
        half = draw.standard_normal((size, size))
        matrix = half + half.T
        known = np.linalg.eigvalsh(matrix)
        for shift in [0.0, *(known + 1e-6), *(known - 1e-6)]:
            assert eigenvalues_above(matrix, shift) == (known > shift).sum()
    assert eigenvalues_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_nothing_to_whiten():
    assert leading_eigenpairs(np.zeros((3, 3)))[0].size == 0
    assert leading_eigenpairs(np.zeros((0, 0)))[0].size == 0


def test_deviation_is_exact_or_null():
    x = np.array([[1_000_064, 1_000_000], [999_900, 1_000_001], [1_000_000, 1_000_001]])
    sums = [int(v) for v in x.sum(axis=0)]
    centre = Centre(3, sums)
    assert centre.deviation(x) == [int(((3 * row - np.array(sums)) ** 2).sum()) for row in x]
    wide = np.array([[2**40, 0], [-(2**40), 0], [5, 0]])
    assert Centre(3, [int(v) for v in wide.sum(axis=0)]).deviation(wide) == [None, None, 100]


def brute(rows, components=32):
    """Rows that stay, and the digest columns from numpy's solver and exact fractions."""
    good = [(k, [float(c) for c in v]) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in good])
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    z = np.array([[float(Fraction(int(v)) - Fraction(s, n)) for v, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    deviations = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [k for k, _ in good], n, deviations, z @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check(found, rows, components=32):
    keys, n, deviations, white, explained = brute(rows, components)
    got = sorted(found.collect(), key=lambda r: (r.component, r.deviation, r.vec_id is None, r.vec_id or 0))
    count = white.shape[1]
    assert len(got) == len(keys) * count
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    at = {}
    for r in got:
        at.setdefault((r.component, r.vec_id, r.deviation), []).append(r)
    for c in range(count):
        sign = 0
        for key, deviation, value in zip(keys, deviations, white[:, c]):
            r = at[c + 1, key, deviation][0]
            sign = sign or np.sign(value * r.whitened)
            assert abs(r.whitened - sign * value) < 1e-6 * max(1, abs(value))
            assert abs(r.explained - explained[c]) < 1e-9


def odd_vectors():
    draw = np.random.default_rng(4)
    rows = [(i, [float(v) for v in draw.standard_normal(6) * np.arange(1, 7) / 4]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(150)] + [(3, rows[3][1]), (None, rows[9][1])]
    return rows


def test_odd_rows(spark):
    rows = odd_vectors()
    dropped = [
        (900, None),
        (901, []),
        (902, [1.0, 2.0, None, 0.0, 0.0, 0.0]),
        (903, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]),
        (904, [float("-inf")] * 6),
        (905, [1.0, 2.0]),
        (906, [1e30, 0.0, 0.0, 0.0, 0.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, 0.5) for r in rows + dropped], "vec_id long, embedding array<float>, n int, whitened double").repartition(6)
    stored = [(r.vec_id, r.embedding) for r in frame.collect() if (r.vec_id, 0) not in {(k, 0) for k, _ in dropped}]
    check(whitening.whiten(frame), stored)
    check(whitening.whiten(frame.repartition(1), 2), stored, 2)


def test_without_components(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0])] * 9, schema)).collect() == []


def test_large_sums_are_exact(spark):
    frame = spark.createDataFrame([(i, [2.0**36 + i, float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
    n, sums = whitening.totals(frame)
    assert (n, sums) == (9, [9 * 2**42 + 64 * 36 + 9_000_000, 64 * 36 + 9_000_000])
    assert all(isinstance(s, int) and not isinstance(s, Decimal) for s in sums)


def test_reruns_agree(spark, sf_dir):
    first, second = (sorted(map(tuple, queries.op13_spectrum_slicing(spark, sf_dir).collect())) for _ in range(2))
    assert first == second


def test_query_on_whole_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(queries.op13_spectrum_slicing(spark, sf_dir), rows)
