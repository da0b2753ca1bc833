"""The given tables as annotated comments, with an invented lexicon of words they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand import fixed_values as fv
from evenhand.functions.text import extract_all, replace_words
from evenhand.functions.unnest import inline_rows

LEXICON = {
    "g_ther": ["ther", "thers", "then"],
    "g_thon": ["thon", "than"],
    "g_thed": ["thed", "thes"],
    "g_erin": ["erin", "eron"],
    "g_anea": ["anea", "eran"],
    "g_le": ["le", "les"],
    "g_none": [],
}
#: Some of the most frequent words, so that a model with few features has them.
FREQUENT_LEXICON = {"f_the": ["The"], "f_and": ["and"], "f_both": ["the", "of", "absent"]}
CATEGORIES = {"c1": ["g_ther", "g_thon", "g_thed"], "c2": ["g_erin", "g_anea"]}
GROUPS = list(LEXICON)
AUDIT_TERMS = {c: [LEXICON[g][0] for g in groups] for c, groups in CATEGORIES.items()}
CATEGORY_WORDS = {c: [w for g in groups for w in LEXICON[g]] for c, groups in CATEGORIES.items()}


#: Session setting: partitions of the documents' texts.
PARTITIONS = "evenhand.documents.partitions"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, comment_text). A file that cannot be split (one row group) is one task; the session may
    name a number of partitions to deal the texts out to, none by default."""
    docs = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("comment_text")
    )
    partitions = spark.conf.get(PARTITIONS, None)
    return docs if partitions is None else docs.repartition(int(partitions))


def synthetic_target(key: Column) -> Column:
    """A continuous score that hits 0, 0.2, 0.5, 0.8 and 1 exactly."""
    return ((key * 37) % 101).cast("double") / 100


def comments(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """(id, comment_text, target_syn, *groups[, target]).

    A group's value is its share of the category's words in the text; a group without a
    category has 1 if any of its words occurs. Words are found before the labels are joined,
    so that only the columns a query needs are shuffled, not the texts.
    """
    every_word = [w for words in LEXICON.values() for w in words]
    words = F.filter(
        extract_all(F.lower("comment_text"), "[a-z0-9]+"), lambda w: w.isin(every_word)
    )
    # The one-element explode keeps the optimizer from copying the word search into every
    # filter on a group column.
    found = documents(spark, sf_dir).select(
        "id", "comment_text", F.explode(F.array(words)).alias("found")
    )

    def hits(terms: list[str]) -> Column:
        if not terms:
            return F.lit(0)
        return F.size(F.filter("found", lambda w: w.isin(terms)))

    values = {}
    for category, groups in CATEGORIES.items():
        total = hits(CATEGORY_WORDS[category])
        for group in groups:
            values[group] = F.when(total > 0, hits(LEXICON[group]) / total).otherwise(0.0)
    for group in GROUPS:
        values.setdefault(group, (hits(LEXICON[group]) > 0).cast("double"))
    df = found.select(
        "id",
        "comment_text",
        synthetic_target(F.col("id")).alias("target_syn"),
        *[values[g].alias(g) for g in GROUPS],
    )
    if not labelled:
        return df
    labels = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("target")
    )
    return df.join(labels, "id", "left")


def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line_no, level, level_pos, template): every line that holds a category word, with
    the words turned into the placeholder. The level follows the document's score."""
    words = [w for terms in CATEGORY_WORDS.values() for w in terms]
    lines = F.transform(
        F.split("comment_text", "\n"),
        lambda line, i: F.struct(
            i.cast("long").alias("line_no"),
            line.alias("line"),
            replace_words(line, words, fv.PLACEHOLDER).alias("template"),
        ),
    )
    score = synthetic_target(F.col("id"))
    level_pos = F.when(score < 1 / 3, 0).when(score < 2 / 3, 1).otherwise(2).cast("long")
    names = F.array(*[F.lit(level) for level in fv.LEVELS])
    changed = F.filter(lines, lambda t: t["template"] != t["line"])
    return inline_rows(
        documents(spark, sf_dir), ["id", level_pos.alias("level_pos")], changed, "line_no"
    ).select(
        "id",
        "line_no",
        F.get(names, F.col("level_pos").cast("int")).alias("level"),
        "level_pos",
        "template",
    )
