import math

import pytest
from pyspark.sql import functions as F

from evenhand.functions import numbers, text

TOKENS = [
    ("Don't STOP, the no\u00a0break space x42!", ["dont", "stop", "no", "break", "space", "x42"]),
    ("a I is the", []),
    ("", []),
    ("tab\tnew\nline\x1csep caf\u00e9 na\u00efve co\u0301mbined", ["tab", "new", "line", "sep", "caf", "nave", "combined"]),
    ("word word other WORD words\u3000wide", ["word", "word", "other", "word", "words", "wide"]),
    ("___ -- !!", []),
    (None, []),
]


def test_clean_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i int, t string")
    rows = df.select("i", text.clean_tokens(F.col("t")).alias("tokens")).collect()
    assert {r["i"]: r["tokens"] for r in rows} == {i: want for i, (_, want) in enumerate(TOKENS)}


def test_term_runs(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>")
    runs = [r[0] for r in df.select(text.term_runs(F.col("t"))).collect()]
    assert [tuple(x) for x in runs[0]] == [("a", 1), ("b", 2)]
    assert runs[1] == []


def test_model_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("Ab c_d x É1 ab",), ("one",), ("",)], "t string")
    got = [r[0] for r in df.select(text.with_bigrams(text.model_tokens(F.col("t")))).collect()]
    assert got[0] == ["ab", "c_d", "é1", "ab", "ab c_d", "c_d é1", "é1 ab"]
    assert got[1] == ["one"]
    assert got[2] == []


MAN, BLACK = ["man", "men"], ["black", "a.c"]
SWAPS = [
    (MAN, "woman", "Man man MAN mEN men's", "Woman woman Woman woman woman's"),
    (MAN, "woman", "man_made manly woman 2man man2", "man_made manly woman 2man man2"),
    (MAN, "woman", "\u00e9man man\u00e9 (man) man,man man-made\nMan", "\u00e9man man\u00e9 (woman) woman,woman woman-made\nWoman"),
    (MAN, "woman", "man man  man", "woman woman  woman"),
    (BLACK, "w$h\\ite", "Black black BLACKK abc a.c A.C", "W$h\\ite w$h\\ite BLACKK abc w$h\\ite W$h\\ite"),
    (BLACK, "w$h\\ite", "B\u043back blac\u212a nothing", "B\u043back w$h\\ite nothing"),
]


@pytest.mark.parametrize("terms,word,before,after", SWAPS)
def test_replace_words(spark, terms, word, before, after):
    df = spark.createDataFrame([(before,)], "t string")
    assert df.select(text.replace_words(F.col("t"), terms, word)).first()[0] == after


def test_model_terms_of_a_fitted_stage_are_the_counted_ones(spark):
    df = spark.createDataFrame([("Ab c_d x \u00c91 ab",), ("one",), ("",)], "t string")
    both = df.select(text.with_bigrams(text.model_tokens(F.col("t"))), F.expr(text.model_terms_sql("t")))
    assert all(a == b for a, b in both.collect())


def test_lenient_numbers(spark):
    values = {
        "": 0.0, None: 0.0, "abc": None, " 0.7 ": 0.7, "0.5d": None, "nan": None, "1_0": 10.0,
        "  ": None, "-1e-1": -0.1, ".5": 0.5, "5.": 5.0, "1__0": None, "_1": None,
        "inf": math.inf, "0x10": None, "1e999": math.inf, "\u00a00.7\u2003": 0.7, "\x1c.5\x85": 0.5,
    }
    df = spark.createDataFrame([(k,) for k in values], "t string")
    got = {r[0]: r[1] for r in df.select("t", numbers.lenient_number(F.col("t"))).collect()}
    assert got == values


def test_strict_number_fails_on_junk(spark):
    df = spark.createDataFrame([("",), (None,), ("0.5",)], "t string")
    assert [r[0] for r in df.select(numbers.strict_number(F.col("t"))).collect()] == [0, 0, 0.5]
    bad = spark.createDataFrame([("abc",)], "t string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.select(numbers.strict_number(F.col("t"))).collect()


def test_preview_cuts_before_replacing(spark):
    df = spark.createDataFrame([("ab\ncd\n" + "x" * 300,)], "t string")
    assert df.select(text.preview(F.col("t"), 4)).first()[0] == "ab c"


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,)], "x double")
    assert [r[0] for r in df.select(numbers.round_half_even(F.col("x"), 2)).collect()] == [0.12, 0.38]
