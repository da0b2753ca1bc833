"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand import fixed_values as fv
from evenhand.functions.numbers import lenient_number
from evenhand.functions.text import model_tokens
from evenhand.functions.unnest import explode_rows
from evenhand.operators import counterfactual, fairness, profile, strata, textmodel, tfidf
from evenhand.operators.mentions import mention_rows
from evenhand.plans import audits
from evenhand.sources import comments as src
from evenhand.sources import sinks, tables
from evenhand.sources.comments import rank_score, with_file_order
from evenhand.sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r(column: str):
    return F.round(column, DIGITS).alias(column)


# ---------------------------------------------------------------- profiles


@query
def row_audit(spark, sf_dir):
    df = tables.comments(spark, sf_dir)
    mentioned = F.size(F.array_compact(F.array(*[F.when(F.col(g) >= 0.5, 1) for g in tables.GROUPS])))
    return profile.row_audit(df, ["comment_text", "target"], mentioned > 0)


@query
def score_describe(spark, sf_dir):
    df = tables.documents(spark, sf_dir).select(
        tables.synthetic_target(F.col("id")).alias("target_syn")
    )
    stats = profile.describe(df, "target_syn")
    return stats.select("n", *[r(c) for c in stats.columns if c != "n"])


@query
def label_describe(spark, sf_dir):
    stats = profile.describe(tables.read(spark, sf_dir, "labels"), "toxic")
    return stats.select("n", *[r(c) for c in stats.columns if c != "n"])


@query
def score_histogram(spark, sf_dir):
    df = tables.documents(spark, sf_dir).select(
        tables.synthetic_target(F.col("id")).alias("target_syn")
    )
    return profile.histogram(df, "target_syn").select("bin", r("bin_lo"), r("bin_hi"), "n")


@query
def length_histogram(spark, sf_dir):
    df = tables.documents(spark, sf_dir).select(F.length("comment_text").alias("n_chars"))
    return profile.histogram(df, "n_chars", 20).select("bin", r("bin_lo"), r("bin_hi"), "n")


@query
def score_bands(spark, sf_dir):
    df = tables.documents(spark, sf_dir).select(
        tables.synthetic_target(F.col("id")).alias("target_syn")
    )
    return profile.band_counts(df, "target_syn")


@query
def eda_identity_toxicity(spark, sf_dir, min_group_size: int = fv.MIN_GROUP_SIZE):
    df = tables.comments(spark, sf_dir)
    found = profile.with_position(
        profile.identity_summary(df, tables.GROUPS, "target", min_group_size=min_group_size)
    )
    position = F.col("position").cast("long").alias("position")
    return found.select("identity", "n_comments", r("mean_toxicity"), r("pct_toxic"), position)


@query
def eda_identity_rounded(spark, sf_dir):
    """The same table with the continuous score, rounded half to even as published."""
    df = tables.comments(spark, sf_dir, labelled=False)
    return profile.identity_summary(df, tables.GROUPS, "target_syn", rounded=True)


@query
def band_samples(spark, sf_dir):
    df = tables.comments(spark, sf_dir, labelled=False)
    return profile.band_samples(df, tables.GROUPS, "target_syn", "comment_text", "id")


@query
def lenient_scores(spark, sf_dir):
    """Leniently parsed fields: the words of each conversation turn and the turn's own
    number in several spellings."""
    turns = tables.read(spark, sf_dir, "conversations")
    fields = F.concat(
        F.array(
            F.lit(""),
            F.concat(F.lit(" "), F.col("turn"), F.lit(".5 ")),
            F.concat(F.col("turn"), F.lit("d")),
            F.concat(F.lit("1_"), F.col("turn")),
            F.concat(F.lit("-"), F.col("turn"), F.lit("e-1")),
            F.lit("nan"),
            F.concat(F.lit("\u00a0"), F.col("turn"), F.lit(".25\u2003")),
        ),
        F.split("text", r"\s+"),
    )
    raw = explode_rows(turns, ["conv_id"], fields, "raw")
    value = raw.select("conv_id", lenient_number(F.col("raw")).alias("value"))
    return value.groupBy("conv_id").agg(
        F.count("*").alias("n_fields"),
        F.count("value").alias("n_numbers"),
        F.round(F.sum("value"), DIGITS).alias("total"),
    )


@query
def document_index(spark, sf_dir):
    return with_file_order(tables.read(spark, sf_dir, "documents")).select("doc_id", "doc_index")


# ---------------------------------------------------------------- written and read files


def _written(spark, df: DataFrame, file_format: str = "csv") -> str:
    path = new_folder(spark, "written")
    sinks.write_table(df, path, file_format)
    return path


def _digest(text: str):
    return F.md5(F.encode(text, "UTF-8")).alias("text_md5")


@query
def csv_scan(spark, sf_dir):
    """Every document written as CSV, whose texts hold newlines, and read by many tasks; two of the
    five columns are parsed."""
    path = _written(spark, tables.read(spark, sf_dir, "documents"))
    rows = src.csv_rows(spark, path, ["doc_id", "text"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text"))


@query
def csv_index(spark, sf_dir):
    """Record numbers of the documents' CSV files, written in the order of their ids."""
    docs = tables.documents(spark, sf_dir).select(
        "comment_text", F.col("id").cast("string").alias("target")
    )
    ordered = docs.repartitionByRange(F.col("target").cast("long"))
    ordered = ordered.sortWithinPartitions(F.col("target").cast("long"))
    rows = src.indexed_comments(spark, _written(spark, ordered))
    return rows.select("doc_index", F.col("target").cast("long").alias("doc_id"), _digest("comment_text"))


@query
def complete_comments(spark, sf_dir):
    kept = profile.drop_missing(tables.comments(spark, sf_dir), ["comment_text", "target"])
    return kept.select("id", "target")


@query
def result_table_files(spark, sf_dir):
    """A result table through both formats of the sink; numbers come back from CSV as text."""
    means = parity_by_level(spark, sf_dir)
    again = src.csv_rows(spark, _written(spark, means))
    kept = spark.read.parquet(_written(spark, means, "parquet"))
    typed = again.select(
        "identity_term", "level", *[F.col(c).cast("double").alias(f"csv_{c}") for c in ("score_a", "score_b")]
    )
    return kept.join(typed, ["identity_term", "level"])


def _variant_files(spark, sf_dir) -> str:
    path = new_folder(spark, "variants")
    sinks.write_variants(stratified_counterfactuals(spark, sf_dir), path)
    return path


@query
def variant_files(spark, sf_dir):
    """The written folders of the strata, read back."""
    rows = src.csv_rows(spark, _variant_files(spark, sf_dir))
    return rows.select(
        F.col("id").cast("long").alias("id"),
        "variant_id",
        "variant_text",
        "is_original",
        F.col("original_toxicity").cast("double").alias("original_toxicity"),
        "stratum",
    )


def _external_scorer(spark, rows: DataFrame, text: str) -> str:
    """A stand-in for an external scorer: reads rows, returns a file of keys and scores."""
    score = (F.length(text) * 7 + F.col("id").cast("long")) % 97 / 96
    return _written(spark, rows.select("id", "variant_id", score.alias("score")).distinct())


@query
def file_score_gaps(spark, sf_dir):
    """Gaps from scores that come back in files: variants are written, the scorer answers for some
    of them, and those without an answer go out a second time."""
    keys = ["id", "variant_id"]
    sent = src.csv_rows(spark, _written(spark, _variants(spark, sf_dir)))
    first = _external_scorer(spark, sent.filter(F.crc32("variant_text") % 3 < 2), "variant_text")
    scores = src.external_scores(spark, first, keys, "score")
    again = src.csv_rows(spark, _written(spark, src.unscored(sent, scores, keys)))
    second = _external_scorer(spark, again, "variant_text")
    scores = scores.unionByName(src.external_scores(spark, second, keys, "score"))
    gaps = fairness.variant_gaps(fairness.attach_scores(sent, scores, keys), "score")
    return gaps.select(
        F.col("id").cast("long").alias("id"), "variant_id", r("variant_score"), r("original_score"), r("score_gap")
    )


# ---------------------------------------------------------------- mentions and strata


def _mentions(spark, sf_dir):
    return mention_rows(tables.comments(spark, sf_dir, labelled=False), tables.GROUPS)


def _ranked(spark, sf_dir):
    return rank_score(_mentions(spark, sf_dir), "target_syn")


@query
def identity_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).select(
        "id",
        F.size("mentions").cast("long").alias("n_mentions"),
        F.array_join("mentions", ",").alias("mentions"),
    )


@query
def optional_mentions(spark, sf_dir):
    """Mentions where some groups have no column: they are skipped."""
    df = tables.comments(spark, sf_dir, labelled=False).drop(*tables.GROUPS[::2])
    return mention_rows(df, tables.GROUPS).select("id", F.array_join("mentions", ",").alias("mentions"))


@query
def mention_ranking(spark, sf_dir):
    rows = _ranked(spark, sf_dir).select("id", "toxicity")
    return strata.with_position(strata.ranked(rows, "toxicity", "id"))


@query
def strata_rows(spark, sf_dir):
    rows = _ranked(spark, sf_dir).select("id", "toxicity")
    return strata.stratify(rows, "toxicity", "id").select("id", "toxicity", "stratum")


@query
def strata_summary(spark, sf_dir):
    rows = _ranked(spark, sf_dir).select("id", "toxicity")
    return strata.summarise_strata(strata.stratify(rows, "toxicity", "id"), "toxicity")


# ---------------------------------------------------------------- counterfactuals


def _variants(spark, sf_dir):
    return counterfactual.variants(
        _ranked(spark, sf_dir), lexicon=tables.LEXICON, categories=tables.CATEGORIES
    )


@query
def counterfactual_variants(spark, sf_dir):
    return _variants(spark, sf_dir)


@query
def counterfactual_changed_counts(spark, sf_dir):
    return (
        _variants(spark, sf_dir)
        .groupBy("variant_id", "is_original")
        .agg(
            F.count("*").alias("n_variants"),
            F.sum(F.length("variant_text")).alias("n_chars"),
        )
    )


@query
def swap_targets(spark, sf_dir):
    targets = {g: counterfactual.swap_target(g, tables.CATEGORIES) for g in tables.GROUPS}
    categories = {
        g: F.lit(counterfactual.category_of(g, tables.CATEGORIES)) for g in tables.GROUPS
    }
    mention = F.col("mention")
    return (
        _mentions(spark, sf_dir)
        .select(F.explode("mentions").alias("mention"))
        .groupBy("mention")
        .agg(F.count("*").alias("n_mentions"))
        .select(
            "mention",
            counterfactual.by_group(mention, categories, F.lit(None)).alias("category"),
            counterfactual.by_group(
                mention, {g: F.lit(t) for g, t in targets.items()}, mention
            ).alias("swap_target"),
            "n_mentions",
        )
    )


@query
def stratified_counterfactuals(spark, sf_dir):
    return audits.stratified_variants(
        tables.comments(spark, sf_dir, labelled=False),
        score="target_syn",
        lexicon=tables.LEXICON,
        categories=tables.CATEGORIES,
    )


def _scored_variants(spark, sf_dir):
    """A stand-in for an external scorer of the written variants."""
    score = (F.length("variant_text") * 7 + F.col("id")) % 97 / 96
    return _variants(spark, sf_dir).select(
        "id", "variant_id", "is_original", score.cast("double").alias("score")
    )


@query
def variant_score_gaps(spark, sf_dir):
    gaps = fairness.variant_gaps(_scored_variants(spark, sf_dir), "score")
    return gaps.select("id", "variant_id", r("variant_score"), r("original_score"), r("score_gap"))


@query
def variant_gap_summary(spark, sf_dir):
    gaps = fairness.variant_gaps(_scored_variants(spark, sf_dir), "score")
    return fairness.summarise_gaps(gaps).select(
        "variant_id", "n_variants", r("mean_gap"), r("mean_abs_gap"), r("max_abs_gap")
    )


# ---------------------------------------------------------------- TF-IDF


@query
def doc_frequency(spark, sf_dir):
    return tfidf.document_frequency(tables.documents(spark, sf_dir))


@query
def corpus_stats(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return tfidf.corpus_stats(docs, tfidf.document_frequency(docs))


@query
def doc_term_counts(spark, sf_dir):
    return tfidf.term_counts(tables.documents(spark, sf_dir))


@query
def tfidf_long(spark, sf_dir):
    return tfidf.tfidf_long(tables.documents(spark, sf_dir)).select("id", "term", r("tfidf"))


@query
def tfidf_top3(spark, sf_dir):
    weights = tfidf.tfidf_long(tables.documents(spark, sf_dir))
    # equal weights must compare equal in every engine, whatever the order of operations
    weights = weights.withColumn("tfidf", F.round("tfidf", 9))
    top = tfidf.top_terms(weights)
    return top.select("id", F.col("rank").cast("long").alias("rank"), "term", r("tfidf"))


@query
def tfidf_first_documents(spark, sf_dir):
    top = audits.first_document_terms(tables.documents(spark, sf_dir))
    return top.select("id", "term", r("tfidf"))


def _label_words(spark, sf_dir):
    """A vocabulary table: the words of the benchmark texts."""
    items = tables.read(spark, sf_dir, "benchmark")
    return explode_rows(items, [], model_tokens(F.col("text")), "term").distinct()


@query
def tfidf_vocab_restricted(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return tfidf.tfidf_long(docs, vocabulary=_label_words(spark, sf_dir)).select(
        "id", "term", r("tfidf")
    )


def _requests(spark, sf_dir):
    """Look-ups of every word of a conversation turn, as written, in the document with eleven
    times the conversation's number, some in white space; many of these documents do not exist."""
    turns = tables.read(spark, sf_dir, "conversations")
    document = (F.col("conv_id") * 11).alias("id")
    words = F.split("text", r"[ \n]+")
    spaced = F.transform(words, lambda w, i: F.when(i % 3 == 0, F.concat(F.lit("\t\u00a0"), w, F.lit("\n"))).otherwise(w))
    return explode_rows(turns, [document], spaced, "term")


@query
def tfidf_lookup(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return tfidf.lookup(_requests(spark, sf_dir), docs).select("id", "term", r("tfidf"))


@query
def tfidf_lookup_missing(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    return tfidf.missing_documents(_requests(spark, sf_dir), docs)


def _labelled_vectors(spark, sf_dir):
    """Vectors of all documents; the labels join them by id, the texts stay where they are."""
    labels = tables.read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("label")
    )
    found = tfidf.vectors(tables.documents(spark, sf_dir), target=None).join(labels, "id", "left")
    return found.select("id", F.coalesce("label", F.lit(0.0)).alias("target"), "vec")


@query
def tfidf_vectors(spark, sf_dir):
    """The map's entries in term order, as term:weight in millionths."""
    entries = F.transform(
        F.map_entries("vec"),
        lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"] * 1_000_000).cast("long")),
    )
    return _labelled_vectors(spark, sf_dir).select("id", "target", F.array_join(entries, " ").alias("vec"))


@query
def tfidf_vector_sizes(spark, sf_dir):
    weights = F.map_values("vec")
    return _labelled_vectors(spark, sf_dir).select(
        "id",
        "target",
        F.cardinality("vec").cast("long").alias("n_terms"),
        F.round(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), DIGITS).alias("total"),
        F.round(F.array_max(weights), DIGITS).alias("largest"),
    )


# ---------------------------------------------------------------- sentence grid and metrics


def _grid(spark, sf_dir):
    return audits.sentence_grid(tables.line_templates(spark, sf_dir), tables.AUDIT_TERMS)


def _audit(spark, sf_dir):
    """The grid with two arithmetic stand-ins for model scores."""
    score_a = (
        F.col("level_pos") * 31 + F.col("id") * 17 + F.col("line_no") * 5 + F.col("term_pos") * 7
    ) % 97 / 96
    score_b = (F.length("sentence") * 3 + F.col("term_pos") * 11 + F.col("id") * 29) % 89 / 88
    return _grid(spark, sf_dir).select(
        "*", score_a.cast("double").alias("score_a"), score_b.cast("double").alias("score_b")
    )


@query
def sentence_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select(
        "id", "line_no", "level", "template", "category", "identity_term", "sentence"
    )


@query
def scored_sentences(spark, sf_dir):
    """The grid joined to a score table kept elsewhere: the labels' quality of the document."""
    labels = tables.read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("external_score")
    )
    grid = _grid(spark, sf_dir).select("id", "line_no", "identity_term", "sentence")
    return fairness.attach_scores(grid, labels, ["id"])


@query
def parity_by_level(spark, sf_dir):
    means = fairness.parity(_audit(spark, sf_dir), ["score_a", "score_b"])
    return means.select("identity_term", "level", r("score_a"), r("score_b"))


@query
def parity_pivot(spark, sf_dir):
    table = fairness.parity_pivot(_audit(spark, sf_dir), "score_b", order_by="score_a")
    return table.select(
        "identity_term", F.col("position").cast("long").alias("position"), *[r(v) for v in fv.LEVELS]
    )


@query
def neutral_means(spark, sf_dir):
    means = fairness.level_means(_audit(spark, sf_dir), "neutral", ["score_a", "score_b"])
    return means.select("identity_term", r("score_a"), r("score_b"))


@query
def level_range(spark, sf_dir):
    return fairness.level_range(_audit(spark, sf_dir), "score_b").select(
        "level", r("min_mean"), "min_term", r("max_mean"), "max_term", r("range")
    )


@query
def category_spread(spark, sf_dir):
    return fairness.category_spread(_audit(spark, sf_dir), "score_b").select(
        "category", r("min_mean"), "min_term", r("max_mean"), "max_term", r("range"), r("ratio")
    )


@query
def group_ratio(spark, sf_dir):
    return fairness.group_ratio(_audit(spark, sf_dir), "score_a").select(
        "level", "max_term", "min_term", r("ratio")
    )


@query
def gap_growth(spark, sf_dir):
    growth = fairness.gap_growth(_audit(spark, sf_dir), "score_b")
    return growth.select(*[r(c) for c in growth.columns])


@query
def pairwise_difference(spark, sf_dir):
    return fairness.pairwise_difference(
        _audit(spark, sf_dir), "score_b", ["id", "line_no"]
    ).select("level", "n_pairs", r("mean_abs_diff"), r("max_abs_diff"))


@query
def pairwise_difference_all_terms(spark, sf_dir):
    return fairness.pairwise_difference(
        _audit(spark, sf_dir), "score_a", ["id", "line_no"], within_category=False
    ).select("level", "n_pairs", r("mean_abs_diff"), r("max_abs_diff"))


@query
def rank_agreement(spark, sf_dir):
    return fairness.rank_agreement(_audit(spark, sf_dir), "score_b").select(
        "level_a", "level_b", r("spearman")
    )


@query
def model_agreement(spark, sf_dir):
    return fairness.model_agreement(_audit(spark, sf_dir), "score_a", "score_b").select(
        "level", r("pearson"), r("spearman")
    )


# ---------------------------------------------------------------- text model


def _training(spark, sf_dir):
    """Labelled documents without the held-out fifth. The labels are few, so the join comes
    before the texts are split into words."""
    labels = tables.read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("target")
    )
    train, _ = textmodel.split(labels.filter(F.col("target").isNotNull()))
    return tables.documents(spark, sf_dir).join(train, "id")


@query
def train_test_split(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return docs.select("id", textmodel.in_test(F.col("id")).alias("in_test"))


@query
def model_vocabulary(spark, sf_dir):
    train = _training(spark, sf_dir)
    terms = textmodel.vocabulary(train)
    n_docs = train.agg(F.count("*")).scalar()
    weight = textmodel.smoothed_idf("df", n_docs)
    return terms.select("term", "tf", "df", F.round(weight, DIGITS).alias("idf"))


def _model(spark, sf_dir):
    return textmodel.fit(_training(spark, sf_dir))


@query
def model_optimality(spark, sf_dir):
    """What holds at the ridge's minimum only: the gradient's largest entry and the mean residual
    are 0, and all vectors with a known term have length 1."""
    return textmodel.optimality(_model(spark, sf_dir), _training(spark, sf_dir)).select(
        F.abs(F.round("largest_gradient", 3)).alias("largest_gradient"),
        F.abs(F.round("mean_residual", 4)).alias("mean_residual"),
        r("unit_vectors"),
    )


@query
def model_scores(spark, sf_dir):
    model = _model(spark, sf_dir)
    grid = _grid(spark, sf_dir).withColumn("comment_text", F.col("sentence"))
    return textmodel.score(model, grid).select(
        "id", "line_no", "level", "category", "identity_term", "local_score"
    )


def _coefficients(spark, sf_dir):
    return textmodel.coefficients(_model(spark, sf_dir), tables.read(spark, sf_dir, "labels"))


@query
def model_top_terms(spark, sf_dir):
    return textmodel.extreme_coefficients(_coefficients(spark, sf_dir))


@query
def model_identity_coefs(spark, sf_dir):
    return textmodel.identity_coefficients(_coefficients(spark, sf_dir), tables.LEXICON)


#: A vocabulary whose normal equations SQL can solve, too.
SMALL_VOCABULARY = 24


def _small_model(spark, sf_dir):
    return textmodel.fit(
        _training(spark, sf_dir), max_features=SMALL_VOCABULARY, closed_form=True
    )


def _small_coefficients(spark, sf_dir):
    return textmodel.coefficients(_small_model(spark, sf_dir), tables.read(spark, sf_dir, "labels"))


@query
def small_model_coefs(spark, sf_dir):
    return _small_coefficients(spark, sf_dir).select("feature", r("coef"))


@query
def small_model_extremes(spark, sf_dir):
    """The five largest and the five smallest coefficients with their positions."""
    top = textmodel.extreme_coefficients(_small_coefficients(spark, sf_dir), 5)
    return top.select("side", F.col("position").cast("long").alias("position"), "feature", r("coef"))


@query
def small_model_identity_coefs(spark, sf_dir):
    found = textmodel.identity_coefficients(
        _small_coefficients(spark, sf_dir), tables.FREQUENT_LEXICON
    )
    return found.select("identity", "feature", r("coef"))


@query
def small_model_scores(spark, sf_dir):
    """Every line of every document, scored by the small model."""
    lines = tables.documents(spark, sf_dir).select(
        "id", F.posexplode(F.split("comment_text", "\n")).alias("line_no", "comment_text")
    )
    scored = textmodel.score(_small_model(spark, sf_dir), lines)
    return scored.select("id", F.col("line_no").cast("long").alias("line_no"), r("local_score"))
