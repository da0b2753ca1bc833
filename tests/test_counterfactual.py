from pyspark.sql import functions as F

from evenhand import fixed_values as fv
from evenhand.operators import counterfactual as cf
from evenhand.operators.mentions import mention_rows

LEXICON = {"x": ["cat", "cats"], "y": ["dog"], "z": ["cow"], "w": ["ant"], "none": [], "lone": ["owl"]}
CATEGORIES = {"animals": ["x", "y", "z"], "insects": ["w", "none"], "birds": ["lone"]}


def run(spark, rows, **options):
    df = spark.createDataFrame(
        rows, "id string, comment_text string, toxicity double, mentions array<string>"
    )
    return [
        tuple(r)
        for r in cf.variants(df, lexicon=LEXICON, categories=CATEGORIES, **options)
        .orderBy("id", F.desc("is_original"), "variant_id")
        .collect()
    ]


def test_swap_targets():
    assert cf.swap_target("male") == "female"
    assert cf.swap_target("female") == "male"
    assert cf.swap_target("bisexual") == "heterosexual"
    assert cf.swap_target("other_disability") == "other_disability"
    assert cf.swap_target("lone", CATEGORIES) == "lone"


def test_two_mentions_with_the_same_target_stay_twice(spark):
    rows = [("1", "Dogs, dog and Cow", 0.5, ["y", "z"])]
    got = run(spark, rows)
    swap = ("1", "swap_to_x", "Dogs, cat and Cat", "false", 0.5)
    assert got == [("1", "original", "Dogs, dog and Cow", "true", 0.5), swap, swap]
    assert len(run(spark, rows, dedup=True)) == 2


def test_only_changed_variants_and_commented_rows(spark):
    got = run(
        spark,
        [
            ("1", "no animal here", 0.1, ["x"]),
            ("2", "", 0.1, ["x"]),
            ("3", None, 0.1, ["x"]),
            ("4", "a cat", 0.1, []),
            ("5", "an ant", 0.2, ["w"]),  # the only other group has no words
            ("6", "an owl", 0.2, ["lone"]),  # no other group
            ("7", "a cat", None, ["x", "lone"]),
        ],
    )
    assert [(g[0], g[1]) for g in got] == [
        ("1", "original"), ("5", "original"), ("6", "original"), ("7", "original"), ("7", "swap_to_y"),
    ]
    assert got[-1][2] == "a dog"


def test_swapping_twice_equals_once(spark):
    df = spark.createDataFrame([("Women and men, Ladies' boys",)], "t string")
    once = cf.swapped_text(F.col("t"), "female")
    row = df.select(once.alias("once"), cf.swapped_text(once, "female").alias("twice")).first()
    assert row["once"] == row["twice"] == "Man and man, Man' man"


def test_default_lexicon_end_to_end(spark):
    df = spark.createDataFrame(
        [("1", "Black cats; a Woman", 0.3, 0.9, 0.6)],
        "id string, comment_text string, toxicity double, black double, female double",
    )
    rows = cf.variants(mention_rows(df, list(fv.LEXICON))).collect()
    assert {(r["variant_id"], r["variant_text"]) for r in rows} == {
        ("original", "Black cats; a Woman"),
        ("swap_to_male", "Black cats; a Man"),
        ("swap_to_white", "White cats; a Woman"),
    }


def test_template_grid(spark):
    df = spark.createDataFrame([("a", "{identity} is {identity}")], "level string, template string")
    rows = cf.fill_templates(df, {"c": ["p", "q"]}).collect()
    assert [(r["category"], r["identity_term"], r["term_pos"], r["sentence"]) for r in rows] == [
        ("c", "p", 0, "p is p"), ("c", "q", 1, "q is q"),
    ]
