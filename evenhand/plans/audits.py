"""The complete audits, each a chain of operators over one comment table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand import fixed_values as fv
from evenhand.operators import counterfactual, fairness, profile, strata, textmodel, tfidf
from evenhand.operators.mentions import mention_rows
from evenhand.sources.comments import rank_score
from evenhand.sources.sinks import write_table, write_variants

Groups = Mapping[str, Sequence[str]]


def stratified_variants(
    rows: DataFrame,
    score: str = "toxicity",
    key: str = "id",
    text: str = "comment_text",
    top_n: int = fv.STRATUM_SIZE,
    middle_n: int = fv.STRATUM_SIZE,
    bottom_n: int = fv.STRATUM_SIZE,
    threshold: float = fv.MENTION_THRESHOLD,
    lexicon: Groups = fv.LEXICON,
    categories: Groups = fv.CATEGORIES,
) -> DataFrame:
    """Mentioning comments, ranked by score, cut to strata, with their counterfactuals."""
    ranked = rank_score(mention_rows(rows, list(lexicon), threshold), score)
    chosen = strata.stratify(ranked, "toxicity", key, top_n, middle_n, bottom_n)
    return counterfactual.variants(
        chosen, key, text, score, "mentions", ["stratum"], lexicon, categories
    )


def bias_audit(rows: DataFrame, output: str, file_format: str = "csv", **parameters) -> DataFrame:
    """Runs ``stratified_variants`` and writes one folder per stratum."""
    variants = stratified_variants(rows, **parameters)
    write_variants(variants, output, file_format)
    return variants


def identity_exploration(
    comments: DataFrame,
    groups: Sequence[str] = fv.PROFILE_GROUPS,
    sample_groups: Sequence[str] = fv.SAMPLE_GROUPS,
    min_group_size: int = fv.MIN_GROUP_SIZE,
) -> dict[str, DataFrame]:
    """Row count, score bands, identity table and sampled comments."""
    return {
        "rows": profile.row_audit(comments, ["comment_text", "target"]),
        "bands": profile.band_counts(comments, "target"),
        "identities": profile.identity_summary(
            comments, groups, "target", min_group_size=min_group_size
        ),
        "samples": profile.band_samples(comments, sample_groups, "target", "comment_text", "id"),
    }


def sentence_grid(
    templates: DataFrame, terms: Groups = fv.AUDIT_TERMS, template: str = "template"
) -> DataFrame:
    """Templates (level, template, ..) crossed with the audit terms."""
    return counterfactual.fill_templates(templates, terms, template)


def default_templates(df: DataFrame) -> DataFrame:
    """The fixed templates as a table (level, template); ``df`` only names the session."""
    rows = [(level, t) for level in fv.LEVELS for t in fv.TEMPLATES[level]]
    return df.sparkSession.createDataFrame(rows, "level string, template string")


def fairness_audit(
    comments: DataFrame,
    templates: DataFrame | None = None,
    terms: Groups = fv.AUDIT_TERMS,
    scores: DataFrame | None = None,
    score: str = "external_score",
    max_features: int = fv.VOCABULARY_SIZE,
) -> tuple[PipelineModel, DataFrame]:
    """Trains the text model on four fifths of the comments and scores the sentence grid.

    ``scores`` is an optional table (sentence, <score>) from an external scorer.
    """
    train, _ = textmodel.split(profile.drop_missing(comments, ["comment_text", "target"]))
    model = textmodel.fit(train, max_features=max_features)
    grid = sentence_grid(default_templates(comments) if templates is None else templates, terms)
    audit = textmodel.score(model, grid.withColumn("comment_text", F.col("sentence")))
    audit = audit.drop("comment_text")
    if scores is not None:
        audit = fairness.attach_scores(audit, scores.select("sentence", score), ["sentence"])
    return model, audit


def fairness_report(audit: DataFrame, first: str, second: str) -> dict[str, DataFrame]:
    """All summaries of an audit table with the scores of two models."""
    report = {
        "neutral_means": fairness.level_means(audit, fv.LEVELS[0], [first, second]),
        "model_agreement": fairness.model_agreement(audit, first, second),
    }
    for name in (first, second):
        report |= {
            f"{name}_pivot": fairness.parity_pivot(audit, name, order_by=first),
            f"{name}_range": fairness.level_range(audit, name),
            f"{name}_spread": fairness.category_spread(audit, name),
            f"{name}_ratio": fairness.group_ratio(audit, name),
            f"{name}_growth": fairness.gap_growth(audit, name),
            f"{name}_pairs": fairness.pairwise_difference(audit, name),
            f"{name}_order": fairness.rank_agreement(audit, name),
        }
    return report


def write_report(report: dict[str, DataFrame], output: str, file_format: str = "csv") -> None:
    for name, table in report.items():
        write_table(table, f"{output}/{name}", file_format)


def first_document_terms(
    docs: DataFrame, key: str = "id", text: str = "comment_text", n: int = 10, k: int = 3
) -> DataFrame:
    """The heaviest terms of the first documents, weighted by the whole corpus."""
    some = tfidf.first_documents(docs, key, n)
    return tfidf.top_terms(tfidf.tfidf_long(some, key, text, corpus=docs), key, k)
