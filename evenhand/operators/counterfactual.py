"""Counterfactual texts: the same comment with the identity words of a category swapped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand import fixed_values as fv
from evenhand.functions.text import replace_words
from evenhand.functions.unnest import inline_rows

Groups = Mapping[str, Sequence[str]]


def category_of(group: str, categories: Groups) -> str | None:
    return next((c for c, members in categories.items() if group in members), None)


def swap_target(group: str, categories: Groups = fv.CATEGORIES) -> str:
    """The first other group of the same category; the group itself if there is none."""
    members = categories.get(category_of(group, categories), [])
    return next((m for m in members if m != group), group)


def swapped_text(
    text: Column, group: str, lexicon: Groups = fv.LEXICON, categories: Groups = fv.CATEGORIES
) -> Column:
    """All words of the group's category replaced by the swap target's first word."""
    target = swap_target(group, categories)
    words = lexicon.get(target, [])
    if target == group or not words:
        return text
    members = categories[category_of(group, categories)]
    return replace_words(text, [w for m in members for w in lexicon.get(m, [])], words[0])


def by_group(mention: Column, values: Mapping[str, Column], default: Column) -> Column:
    """CASE mention WHEN group THEN value ...; only the matching branch is evaluated."""
    chosen = default
    for group, value in reversed(list(values.items())):
        chosen = F.when(mention == group, value).otherwise(chosen)
    return chosen


def variants(
    df: DataFrame,
    key: str = "id",
    text: str = "comment_text",
    score: str = "toxicity",
    mentions: str = "mentions",
    keep: Sequence[str] = (),
    lexicon: Groups = fv.LEXICON,
    categories: Groups = fv.CATEGORIES,
    dedup: bool = False,
) -> DataFrame:
    """The original of every mentioning comment plus one variant per mention that changes it.

    A narrow transformation: the variants are built in an array beside the original and
    exploded, so nothing is scanned twice or shuffled. Two mentions that swap to the same
    word give two equal variants, unless ``dedup`` is set.
    """
    groups = [g for g in lexicon if swap_target(g, categories) != g]
    swaps = {g: swapped_text(F.col(text), g, lexicon, categories) for g in groups}
    targets = {g: F.lit(swap_target(g, categories)) for g in groups}

    def variant(mention: Column) -> Column:
        return F.struct(
            F.concat(F.lit("swap_to_"), by_group(mention, targets, mention)).alias("variant_id"),
            by_group(mention, swaps, F.col(text)).alias("variant_text"),
            F.lit("false").alias("is_original"),
        )

    original = F.struct(
        F.lit("original").alias("variant_id"),
        F.col(text).alias("variant_text"),
        F.lit("true").alias("is_original"),
    )
    swapped = F.filter(
        F.transform(F.col(mentions), variant), lambda v: v["variant_text"] != F.col(text)
    )
    if dedup:
        swapped = F.array_distinct(swapped)
    commented = df.filter(
        F.col(text).isNotNull() & (F.col(text) != "") & (F.size(F.col(mentions)) > 0)
    )
    return inline_rows(
        commented,
        [F.col(key).alias("id"), *keep, F.col(score).alias("original_toxicity")],
        F.concat(F.array(original), swapped),
        "variant_id",
    ).select("id", "variant_id", "variant_text", "is_original", "original_toxicity", *keep)


def fill_templates(
    templates: DataFrame,
    terms: Groups = fv.AUDIT_TERMS,
    template: str = "template",
) -> DataFrame:
    """Every template with every audit term. The term list is a parameter, so the product is
    an explode of a constant array and needs no join."""
    structs = [
        F.struct(
            F.lit(category).alias("category"),
            F.lit(term).alias("identity_term"),
            F.lit(position).cast("long").alias("term_pos"),
        )
        for position, (category, term) in enumerate(
            (c, t) for c, members in terms.items() for t in members
        )
    ]
    return templates.select("*", F.inline(F.array(*structs))).withColumn(
        "sentence", F.replace(F.col(template), F.lit(fv.PLACEHOLDER), F.col("identity_term"))
    )
