from __future__ import annotations

import random

import pytest

WORDS = "the river stone walks under bright morning light and seven quiet birds cross cold water near old mill".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source): nulls, empty, long, repeated and tied rows, several scripts."""
    rows = [(i, prose(i, 5 + 7 * (i % 23)), f"src{i % 4}") for i in range(60)]
    rows += [(100 + i, prose(3, 26), "src0") for i in range(12)]
    rows += [(None, prose(900, 40), "src1"), (None, prose(901, 40), None), (200, None, "src2")]
    rows += [(201, "", "src2"), (202, " \t\n ", "src3"), (203, None, None), (5, prose(5, 40), "src1")]
    rows += [(204, prose(77, 9000), "src9"), (205, "Ünïcode ßtraße 東京 \U0001f600 word " * 9, "ä")]
    rows += [(206, prose(204, 30), "src1")] * 3
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """With further columns whose names the operators use inside."""
    rows = [(*r, 1, "x", 2.0, "y") for r in odd_rows]
    names = "doc_id long, text string, source string, n int, size string, fp double, `group` string"
    return spark.createDataFrame(rows, names).repartition(5)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
