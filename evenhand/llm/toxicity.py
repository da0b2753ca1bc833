"""Toxicity by a classifier chain.

The categories are predicted one after the other. The linear model of a category sees the words
of the document and the probabilities of the categories before it; in training these are
out-of-fold predictions, so later models do not learn from earlier models' memory.

Models are fitted on at most `max_rows` labelled documents (those with the smallest hash of the
id, so a sample without regard to content) and applied to every document in one narrow pass of
Spark ML transformers. Words are chosen by the likelihood ratio of their presence against any
category, so long documents do not drown few telling words in thousands of others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import checkpoint

MAX_ROWS = 20_000
MAX_WORDS = 2_000
LEAST_DOCS = 5
LEAST_RATIO = 20.0
FOLDS = 3
THRESHOLD = 0.5
REGULARISATION = 1e-4
CATEGORIES = ("low_quality", "toxic")


def words(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits of the whole text; null has none."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(runs, lambda w: w != ""))


@dataclass
class Chain:
    """Models by category; a number instead of a model is a constant probability."""

    categories: Sequence[str]
    vectors: CountVectorizerModel | None
    models: list[LogisticRegressionModel | float] = field(default_factory=list)

    def transform(self, df: DataFrame, word_column: str) -> DataFrame:
        """`df` with one column p_<category> for every category of the chain so far."""
        if self.vectors is not None:
            df = self.vectors.setInputCol(word_column).setOutputCol("__words").transform(df)
        for place, model in enumerate(self.models):
            df = _with_probability(df, model, list(self.categories[:place]), self.categories[place])
        return df.drop("__words")


def _with_probability(df: DataFrame, model, earlier: list[str], category: str) -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(f"p_{category}", F.lit(model))
    inputs = ["__words", *[f"p_{c}" for c in earlier]]
    df = VectorAssembler(inputCols=inputs, outputCol="__features").transform(df)
    return (
        model.transform(df)
        .withColumn(f"p_{category}", vector_to_array("__probability")[1])
        .drop("__features", "__raw", "__probability", "__prediction")
    )


def _fit(df: DataFrame, earlier: list[str], category: str) -> LogisticRegressionModel | float:
    n, positive = df.agg(F.count("*"), F.coalesce(F.sum(category), F.lit(0))).first()
    if positive in (0, n):
        return float(positive) / max(n, 1)
    inputs = ["__words", *[f"p_{c}" for c in earlier]]
    data = VectorAssembler(inputCols=inputs, outputCol="__features").transform(df)
    estimator = LogisticRegression(
        featuresCol="__features",
        labelCol=category,
        rawPredictionCol="__raw",
        probabilityCol="__probability",
        predictionCol="__prediction",
        regParam=REGULARISATION,
        maxIter=60,
    )
    return estimator.fit(data)


def _ratio(n: Column, docs: Column, both: Column, positive: Column) -> Column:
    """Likelihood ratio (G squared) of a word's presence and a label, from four counts."""

    def cell(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    return 2 * (
        cell(both, docs, positive)
        + cell(docs - both, docs, n - positive)
        + cell(positive - both, n - docs, positive)
        + cell(n - docs - positive + both, n - docs, n - positive)
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str] = CATEGORIES,
    id: str = "doc_id",
    text: str = "text",
    max_rows: int = MAX_ROWS,
    folds: int = FOLDS,
) -> Chain:
    """A chain over 0/1 columns of `labels`. Rows with a null id or label are not used; of
    several rows of one id the largest label counts. Without usable rows every probability is 0;
    a category with one value only is a constant."""
    chosen = (
        labels.groupBy(F.col(id).alias("id"))
        .agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories])
        .dropna()
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    sample = checkpoint(
        docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "id")  # max_rows small rows
        .select("id", *categories, F.pmod(F.xxhash64("id", F.lit(7)), F.lit(folds)).alias("fold"), words(F.col("text")).alias("w"))
    )
    n, *positive = sample.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0.0)) for c in categories]).first()
    seen = sample.select(*categories, F.explode("w").alias("word")).groupBy("word")
    seen = seen.agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in categories])
    ratios = [_ratio(F.lit(float(n)), F.col("docs"), F.col(c), F.lit(p)) for c, p in zip(categories, positive, strict=True)]
    best = F.greatest(*ratios) if len(ratios) > 1 else ratios[0]
    telling = (
        seen.filter(F.col("docs") >= LEAST_DOCS)
        .select("word", best.alias("ratio"))
        .filter(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.desc("ratio"), "word")
        .limit(MAX_WORDS)
    )
    vocabulary = [r["word"] for r in telling.collect()]
    if not vocabulary:
        return Chain(categories, None, [float(p) / max(n, 1) for p in positive])
    vectors = CountVectorizerModel.from_vocabulary(sorted(vocabulary), inputCol="w", outputCol="__words")
    vectors.setBinary(True).setMinTF(1.0)
    data = checkpoint(vectors.transform(sample).drop("w"))
    chain = Chain(categories, vectors)
    for place, category in enumerate(categories):
        earlier = list(categories[:place])
        chain.models.append(_fit(data, earlier, category))
        if place + 1 < len(categories):
            parts = []
            for fold in range(folds):
                model = _fit(data.filter(F.col("fold") != fold), earlier, category)
                parts.append(_with_probability(data.filter(F.col("fold") == fold), model, earlier, category))
            out_of_fold = parts[0]
            for part in parts[1:]:
                out_of_fold = out_of_fold.union(part)
            data = checkpoint(out_of_fold)
    return chain


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str] = CATEGORIES,
    id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    **options,
) -> DataFrame:
    """(doc_id, p_<category>..., toxic): the probabilities of every document, and whether that of
    the last category reaches `threshold`. One row per row of `docs`, repeated or null ids
    included; null and empty texts have no words. An empty table gives no rows."""
    chain = fit(docs, labels, categories, id, text, **options)
    scored = chain.transform(
        docs.select(F.col(id).alias("doc_id"), words(F.col(text)).alias("__w")), "__w"
    )
    p = F.col(f"p_{categories[-1]}")
    return scored.select("doc_id", *[f"p_{c}" for c in categories], (p >= threshold).alias("toxic"))


def clean_documents(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of `docs`, all columns, whose toxicity stays under `threshold`."""
    chain = fit(docs, labels, text=text, **options)
    held = docs.select(F.struct(*docs.columns).alias("__row"), words(F.col(text)).alias("__w"))
    scored = chain.transform(held, "__w")
    return scored.filter(F.col(f"p_{chain.categories[-1]}") < threshold).select("__row.*")


def labels_of(labels: DataFrame) -> DataFrame:
    """The given `labels` with the chain's categories: low quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
