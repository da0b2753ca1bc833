"""Ridge regression on normalised TF-IDF features with Spark ML."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand import fixed_values as fv
from evenhand.functions.text import model_terms_sql, model_tokens, stable_hash
from evenhand.functions.unnest import inline_rows
from evenhand.operators import ranks
from evenhand.sources.shared import checkpointed

LOG = logging.getLogger(__name__)
BLOCK = 4_096  # numbers of a partial vector that travel together
COUNTERS = 500_000  # terms of a task's summary, at most four times as many
WORDS = 250_000  # tokens that a task counts at once
RUNS = 10_000  # counts that a task adds to its summary at once
LISTED_TERMS = 1_000_000  # candidates that every task gets a list of
FAN_IN = 32  # pieces of a block that one task adds
TIE_DIGITS = 9
DENSE_FEATURES = 1_000  # features whose matrix of products fits the driver
ENTRIES = 250_000  # entries of rows that a solver's task handles at once
DENSE_ROWS = 2_000  # rows that a task writes out as a dense matrix at once
TASKS_PER_CORE = 2  # of a solver's pass
KINDS = {"lengths": np.int32, "indices": np.int32, "values": np.float64, "labels": np.float64}
KEPT_NUMBERS = 5_000_000  # of earlier residuals that the driver keeps


def in_test(key: Column, seed: int = fv.SPLIT_SEED) -> Column:
    """True for about a fifth of the keys; the same keys for any partitioning."""
    return F.pmod(stable_hash(key, seed), F.lit(5)) == 0


def split(df: DataFrame, key: str = "id", seed: int = fv.SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    test = in_test(F.col(key), seed)
    return df.filter(~test), df.filter(test)


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """(term, tf, df) of the unigrams and bigrams of some documents after others, whose tokens the first
    column holds: WORDS tokens at once, or one document. Terms are counted as numbers, by sorting
    (token), (token, token) and (document, term) codes; a string is made of every term once."""
    for batch in batches:
        lists = batch.column(0).drop_null()
        offsets, tokens, start = lists.offsets.to_numpy(), lists.flatten(), 0
        offsets = (offsets - offsets[0]).astype(np.int64)
        while start < len(lists):
            end = int(np.searchsorted(offsets, offsets[start] + WORDS, side="right")) - 1
            end = min(max(end, start + 1), len(lists))
            coded = tokens.slice(offsets[start], offsets[end] - offsets[start]).dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(end - start), np.diff(offsets[start : end + 1]))
            start, n_words = end, len(words)
            if not n_words:
                continue
            together = row[1:] == row[:-1]
            pairs = (codes[:-1] * n_words + codes[1:])[together] + n_words
            terms, rows = np.concatenate([codes, pairs]), np.concatenate([row, row[1:][together]])
            each = n_words * (n_words + 1)
            in_rows = _counted(rows * each + terms)[0] % each
            (found, tf), (_, df) = _counted(terms), _counted(in_rows)
            n_single = int(np.searchsorted(found, n_words))
            first, second = np.divmod(found[n_single:] - n_words, n_words)
            names = [words.take(pa.array(x)) for x in (found[:n_single], first, second)]
            names = pa.concat_arrays([names[0], pc.binary_join_element_wise(names[1], names[2], " ")])
            yield pa.table([names, tf, df], names=["term", "tf", "df"])


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs."""
    values = np.sort(values)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[starts], np.diff(starts, append=len(values))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts as runs (term, cnt, df) for a summary, RUNS at once."""
    for counts in _term_counts(batches):
        for batch in counts.combine_chunks().to_batches(max_chunksize=RUNS):
            runs = pa.StructArray.from_arrays(batch.columns, ["term", "cnt", "df"])
            yield pa.RecordBatch.from_arrays([runs], ["run"])


def _summary(batches: Iterable[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """(term, tf, df) of a task's documents with bounded memory, and one row without a term that has
    the error in tf: Misra-Gries summaries. Beyond twice `counters` terms the count of the
    term at place `counters` is taken off all, and terms with nothing left are forgotten. The first
    column holds a run, or a list of runs, in each row; with single runs a batch's size does not
    depend on the documents'. A run is of one document unless it says of how many (df)."""
    held, waiting, error = [], 0, 0
    names = ["term", "tf", "df"]

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by("term").aggregate([("tf", "sum"), ("df", "sum")])
        return sums.select(["term", "tf_sum", "df_sum"]).rename_columns(names)

    for batch in batches:
        runs = batch.column(0)
        if pa.types.is_list(runs.type):
            runs = runs.flatten()
        own = runs.type.get_field_index("df") >= 0
        df = runs.field("df") if own else np.ones(len(runs), np.int64)
        held.append(pa.table([runs.field("term"), runs.field("cnt"), df], names=names))
        waiting += len(runs)
        if waiting > 2 * counters:
            found = merged()
            if len(found) > 2 * counters:
                tf = found["tf"].to_numpy()
                cut = int(np.partition(tf, -counters)[-counters])
                error += cut
                found = found.set_column(1, "tf", pa.array(tf - cut)).filter(pa.array(tf > cut))
            held, waiting = [found], 0
    if held:
        yield from merged().to_batches()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([error]), pa.array([0])], names)


def vocabulary(
    docs: DataFrame,
    text: str = "comment_text",
    max_features: int = fv.VOCABULARY_SIZE,
    counters: int = COUNTERS,
) -> DataFrame:
    """(term, tf, df) of the most frequent unigrams and bigrams, ties in term order.

    Every task sends a summary of its terms, at most four times `counters`, with the most that a count can
    be short of; the errors of all tasks add up to E. Where E is 0 the sums are exact. Otherwise the
    count at the vocabulary's last place, short as it may be, is a floor for the true one, and only
    terms whose count can reach it with E more are counted again, exactly. Should the floor not be above
    E, terms that no summary holds could belong, and all terms are counted. The last term is found
    by a search over ranks, then a filter keeps it and those before it; no task collects
    candidates of all others.
    """
    # Sorting each document's terms as strings in the JVM took most of the time.
    tokens = docs.select(model_tokens(F.col(f"`{text}`")).alias("tokens"))
    kind = "term string, tf long, df long"
    parts = checkpointed(tokens.mapInArrow(lambda batches: _summary(_runs(batches), counters), kind))
    error = parts.filter("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("error")).first()["error"]
    sums = [F.sum("tf").alias("tf"), F.sum("df").alias("df")]
    counted = checkpointed(parts.filter("term is not null").groupBy("term").agg(*sums))
    floor = _floor(counted, max_features)
    if error:
        every = tokens.mapInArrow(lambda batches: (b for t in _term_counts(batches) for b in t.to_batches()), kind)
        if floor is not None and floor > error:
            possible = counted.filter(F.col("tf") + error >= floor).select("term")
            small = possible.count() <= LISTED_TERMS  # otherwise all terms meet them in a shuffle
            every = every.join(F.broadcast(possible) if small else possible, "term", "left_semi")
        counted = checkpointed(every.groupBy("term").agg(*sums))
        floor = _floor(counted, max_features)
    if floor is not None:  # the search reads its rows about ten times
        counted = checkpointed(counted.filter(F.col("tf") >= floor))
    last = _last_term(counted, max_features)
    if last is not None:
        columns = ["fewer", "term"]
        ordered = counted.withColumn("fewer", -F.col("tf"))
        counted = ordered.filter(ranks.before(columns, [ordered.schema[c].dataType for c in columns], last, True))
    return counted.select("term", "tf", "df").orderBy(F.desc("tf"), "term")


def _floor(counted: DataFrame, max_features: int) -> int | None:
    """The count at the vocabulary's last place; None if there are no more terms than places. The driver
    gets the distinct counts, at most as many as the root of twice the tokens and pairs."""
    counts = sorted(map(tuple, counted.groupBy("tf").count().collect()), reverse=True)
    places = np.cumsum([n for _, n in counts])
    if not counts or places[-1] <= max_features:
        return None
    return counts[int(np.searchsorted(places, max_features))][0]


def _last_term(counted: DataFrame, max_features: int) -> tuple | None:
    """(-tf, term) at the vocabulary's last place; None if there are no more terms than places."""
    n_terms = counted.count()
    if n_terms <= max_features:
        return None
    ordered = counted.select((-F.col("tf")).alias("fewer"), "term")
    return ranks.keys_at_ranks(ordered, ["fewer", "term"], [max_features - 1], n_terms)[max_features - 1]


def smoothed_idf(df: str, n_docs: Column) -> Column:
    return F.ln((n_docs + 1) / (F.col(df) + 1)) + 1


def feature_stages(
    train: DataFrame, text: str = "comment_text", max_features: int = fv.VOCABULARY_SIZE
) -> list:
    """Fitted stages text -> ``features``. Only the vocabulary, at most ``max_features``
    rows, comes to the driver."""
    n_docs = train.count()
    terms = (
        vocabulary(train, text, max_features)
        .select("term", smoothed_idf("df", F.lit(n_docs)).alias("idf"))
        .persist()
    )
    # Every term of the table occurs once, so fitting keeps exactly these terms; a list
    # handed over from Python would cross the gateway term by term.
    counter = CountVectorizer(
        vocabSize=max_features, inputCol="__terms", outputCol="__counts"
    ).fit(terms.select(F.array("term").alias("__terms")))
    table = terms.toArrow()
    terms.unpersist()
    weights = dict(zip(table["term"].to_pylist(), table["idf"].to_pylist()))
    return [
        SQLTransformer(statement=f"SELECT *, {model_terms_sql(text)} AS __terms FROM __THIS__"),
        counter,
        ElementwiseProduct(
            scalingVec=Vectors.dense([weights[term] for term in counter.vocabulary]),
            inputCol="__counts",
            outputCol="__weighted",
        ),
        Normalizer(p=2.0, inputCol="__weighted", outputCol="features"),
        SQLTransformer(
            statement="SELECT * EXCEPT (__terms, __counts, __weighted) "
            "FROM __THIS__"
        ),
    ]


class Solution(NamedTuple):
    coefs: np.ndarray
    intercept: float
    passes: int  # over the rows


def total(
    rows: DataFrame, n_parts: int, width: int, partial: Callable[[Iterable[pa.RecordBatch]], np.ndarray]
) -> np.ndarray:
    """Sum over all partitions of the vector of ``width`` numbers that ``partial`` makes of each.

    Vectors are cut into blocks and added in a tree: a task of any level reads at most FAN_IN pieces
    of a block at once, however many partitions the rows have. The driver gets one vector.
    """

    def cut(batches):
        sums = partial(batches)
        leaf = TaskContext.get().partitionId()
        for block, start in enumerate(range(0, width, BLOCK)):
            piece = sums[start : start + BLOCK]
            if piece.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([leaf]), pa.array([piece], pa.list_(pa.float64()))],
                    ["block", "leaf", "sums"],
                )

    parts = rows.mapInArrow(cut, "block long, leaf long, sums array<double>")
    # In the order of the leaves, so reruns agree to the last bit.
    pieces = F.sort_array(F.collect_list(F.struct("leaf", "sums")))["sums"]
    zeros = F.array_repeat(F.lit(0.0), F.size(F.get(pieces, F.lit(0))))
    added = F.aggregate(pieces, zeros, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    while True:
        n_parts = -(-n_parts // FAN_IN)
        joined = F.floor(F.col("leaf") / FAN_IN) if n_parts > 1 else F.lit(0).cast("long")
        parts = parts.groupBy("block", joined.alias("leaf")).agg(added.alias("sums"))
        if n_parts <= 1:
            break
    found, result = parts.toArrow(), np.zeros(width)
    for block, sums in zip(found["block"].to_pylist(), found["sums"]):
        result[block * BLOCK : block * BLOCK + BLOCK] = np.asarray(sums.values)
    return result


def _row_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of the batch's entries, and the labels."""
    lists = batch.column(0)
    lengths = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy(), batch.column(2).to_numpy()


def _head(rows: DataFrame) -> tuple[int, float, int]:
    """Number of rows, mean label, number of partitions."""
    placed = rows.select("label", F.spark_partition_id().alias("part"))
    counts = [F.count("*").alias("n"), F.avg("label").alias("mean"), (F.max("part") + 1).alias("parts")]
    head = placed.agg(*counts).first()
    if not head["n"]:
        raise ValueError("no rows to fit a model to")
    return head["n"], head["mean"], head["parts"]


def packed(rows: DataFrame) -> DataFrame:
    """Rows (indices, values, label) as blocks of at most ENTRIES entries (or one row): n, label_sum and
    the arrays lengths, indices, values, labels as bytes. A pass copies them and converts nothing, and
    what a task holds at once does not depend on the rows' or the batches' sizes."""

    def blocks(batches):
        for batch in batches:
            offsets, labels = batch.column(0).offsets.to_numpy(), batch.column(2).to_numpy()
            indices, values = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            offsets, start = offsets - offsets[0], 0
            while start < len(labels):
                end = int(np.searchsorted(offsets, offsets[start] + ENTRIES, side="right")) - 1
                end = min(max(end, start + 1), len(labels), start + ENTRIES)
                own = slice(offsets[start], offsets[end])
                arrays = [
                    np.diff(offsets[start : end + 1]).astype(np.int32),
                    indices[own].astype(np.int32),
                    values[own].astype(np.float64),
                    labels[start:end].astype(np.float64),
                ]
                columns = [pa.array([end - start]), pa.array([float(labels[start:end].sum())])]
                columns += [pa.array([x.tobytes()], pa.binary()) for x in arrays]
                yield pa.RecordBatch.from_arrays(columns, ["n", "label_sum", "lengths", "indices", "values", "labels"])
                start = end

    return rows.mapInArrow(
        blocks, "n long, label_sum double, lengths binary, indices binary, values binary, labels binary"
    )


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length) of the rows of every packed block, (index, value) of their entries, and the labels."""
    for batch in batches:
        for i in range(batch.num_rows):
            lengths, indices, values, labels = (
                np.frombuffer(batch[name][i].as_buffer(), kind) for name, kind in KINDS.items()
            )
            yield lengths, indices.astype(np.intp), values, labels


def _row_sums(weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the entries' weights by row; about twice as fast as counting row numbers."""
    sums, filled = np.zeros(len(lengths)), lengths > 0
    if len(weights):
        sums[filled] = np.add.reduceat(weights, (np.cumsum(lengths) - lengths)[filled])
    return sums


def _packed_head(blocks: DataFrame) -> tuple[int, float, int]:
    """Number of rows, mean label, number of partitions of packed rows."""
    placed = blocks.select("n", "label_sum", F.spark_partition_id().alias("part"))
    sums = [F.sum("n").alias("n"), F.sum("label_sum").alias("labels"), (F.max("part") + 1).alias("parts")]
    head = placed.agg(*sums).first()
    if not head["n"]:
        raise ValueError("no rows to fit a model to")
    return head["n"], head["labels"] / head["n"], head["parts"]


def ridge(
    rows: DataFrame,
    n_features: int,
    alpha: float = fv.RIDGE_ALPHA,
    tolerance: float = 1e-7,
    max_iterations: int = 1_000,
) -> Solution:
    """Coefficients and intercept of least squares plus alpha times the squared norm.

    ``rows`` holds (indices, values, label). The centred normal equations are solved by conjugate
    gradients, preconditioned with their diagonal: each step is one pass over the packed rows that
    multiplies by the matrix and its transpose inside the tasks; partial vectors are added in a tree
    (``_added``). Only vectors of ``n_features`` numbers reach the driver. (LinearRegression works on
    scaled features, where many rare terms make the same problem so badly conditioned that it is
    far from the minimum after hundreds of steps.) The driver keeps the first residuals, at most
    KEPT_NUMBERS numbers, and makes each later one orthogonal to them: rounding errors would bring the
    matrix's largest eigenvalues back in again and again, which took up to half of all steps. Without
    convergence it fails. The number of passes does not depend on the number of tasks; it grows
    slowly with the rows.
    """

    def arrays(packed_rows):
        for row in packed_rows:
            yield tuple(np.frombuffer(row[name], kind) for name, kind in KINDS.items())

    # Python objects in the cache: a pass reads them two to three times as fast as through Arrow batches.
    blocks = packed(rows).rdd.mapPartitions(arrays).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _conjugate_gradients(blocks, n_features, alpha, tolerance, max_iterations)
    finally:
        blocks.unpersist()


def _added(blocks: RDD, partial: Callable[[Iterable[tuple]], np.ndarray]) -> np.ndarray:
    """Sum over all partitions of the vector that ``partial`` makes of each, in a tree: a task or the
    driver gets at most FAN_IN vectors at once. In the order of the leaves, as in ``total``."""

    def leaf(place, own):
        yield place, partial(own)

    def in_order(vectors):
        return sum(vector for _, vector in sorted(vectors, key=lambda v: v[0]))

    parts, n_parts = blocks.mapPartitionsWithIndex(leaf), blocks.getNumPartitions()
    while n_parts > FAN_IN:
        n_parts = -(-n_parts // FAN_IN)
        parts = parts.keyBy(lambda v: v[0] // FAN_IN).groupByKey(n_parts).mapValues(in_order)
    return in_order(parts.collect())


def _conjugate_gradients(
    blocks: RDD, n_features: int, alpha: float, tolerance: float, max_iterations: int
) -> Solution:
    n, label_sum = blocks.map(lambda block: (len(block[3]), float(block[3].sum()))).fold(
        (0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1])
    )
    if not n:
        raise ValueError("no rows to fit a model to")
    mean = label_sum / n
    # A pass is short: its tasks and partial vectors are as many as the cores need, not as the files' pieces.
    blocks = blocks.coalesce(TASKS_PER_CORE * blocks.context.defaultParallelism)

    def first_sums(own):
        """X'1, X'label and the squares of every feature."""
        sums = np.zeros((3, n_features))
        for lengths, indices, values, labels in own:
            for out, weights in zip(sums, (values, values * np.repeat(labels, lengths), values * values)):
                out += np.bincount(indices, weights, minlength=n_features)
        return sums

    def product(direction: np.ndarray):
        """X'(X direction)"""

        def partial(own):
            sums = np.zeros(n_features)
            for lengths, indices, values, _ in own:
                indices = indices.astype(np.intp)
                weights = direction.take(indices)
                weights *= values
                image = _row_sums(weights, lengths)
                np.multiply(np.repeat(image, lengths), values, out=weights)
                sums += np.bincount(indices, weights, minlength=n_features)
            return sums

        return _added(blocks, partial)

    column_sums, label_products, squares = _added(blocks, first_sums)
    means = column_sums / n
    diagonal = squares - column_sums * means + alpha
    residual = label_products - column_sums * mean
    coefs = np.zeros(n_features)
    guided = residual / diagonal
    direction, size = guided.copy(), residual @ guided
    start, steps = residual @ residual, 0
    scale = np.sqrt(diagonal)
    kept = np.empty((max(1, min(max_iterations, KEPT_NUMBERS // max(1, n_features))), n_features))
    while residual @ residual > tolerance**2 * start:
        if steps == max_iterations:
            left = (residual @ residual) ** 0.5
            raise RuntimeError(f"no convergence in {steps} steps: residual {left:g}, first {start**0.5:g}")
        if steps < len(kept):
            kept[steps] = residual / scale / size**0.5
        image = product(direction)
        image += alpha * direction - column_sums * (means @ direction)
        step = size / (direction @ image)
        coefs += step * direction
        residual -= step * image
        earlier, scaled = kept[: steps + 1], residual / scale
        for _ in range(2):  # what rounding errors leave of the earlier ones
            scaled -= earlier.T @ (earlier @ scaled)
        residual = scaled * scale
        guided = scaled / scale
        previous, size = size, residual @ guided
        direction = guided + size / previous * direction
        steps += 1
    LOG.info("ridge: %d rows, %d features, %d passes", n, n_features, steps + 2)
    return Solution(coefs, float(mean - means @ coefs), steps + 2)


def normal_equations(rows: DataFrame, n_features: int, alpha: float = fv.RIDGE_ALPHA) -> Solution:
    """The same minimum for a small vocabulary in closed form: two passes over the rows, whatever the
    conditioning. The matrix of ``n_features`` squared numbers is added up like any other vector
    (``total``) and solved on the driver, so more than DENSE_FEATURES features are refused."""
    if n_features > DENSE_FEATURES:
        raise ValueError(f"{n_features} features make too large a matrix: use ridge()")
    blocks = packed(rows).persist()
    try:
        n, mean, n_parts = _packed_head(blocks)
        size = n_features + 2  # the features, a column of ones, the label

        def products(batches):
            sums = np.zeros((size, size))
            for lengths, indices, values, labels in _blocks(batches):
                row = np.repeat(np.arange(len(lengths)), lengths)
                for start in range(0, len(labels), DENSE_ROWS):
                    end = min(start + DENSE_ROWS, len(labels))
                    own = slice(*np.searchsorted(row, [start, end]))
                    dense = np.zeros((end - start, size))
                    dense[row[own] - start, indices[own]] = values[own]
                    dense[:, -2], dense[:, -1] = 1.0, labels[start:end]
                    sums += dense.T @ dense
            return sums.ravel()

        sums = total(blocks, n_parts, size * size, products).reshape(size, size)
    finally:
        blocks.unpersist()
    means = sums[:-2, -2] / n
    matrix = sums[:-2, :-2] - n * np.outer(means, means) + alpha * np.eye(n_features)
    coefs = np.linalg.solve(matrix, sums[:-2, -1] - n * means * mean)
    return Solution(coefs, float(mean - means @ coefs), 2)


def linear_model(coefs: np.ndarray, intercept: float) -> LinearRegressionModel:
    """The library's own model around given parameters, built as the library builds a
    vocabulary model from a given vocabulary; it scores on the JVM and can be saved."""
    java_model = LinearRegressionModel._new_java_obj(
        "org.apache.spark.ml.regression.LinearRegressionModel",
        "ridge",
        Vectors.dense(coefs),
        float(intercept),
    )
    return LinearRegressionModel(java_model)


def fit(
    train: DataFrame,
    text: str = "comment_text",
    label: str = "target",
    alpha: float = fv.RIDGE_ALPHA,
    max_features: int = fv.VOCABULARY_SIZE,
    closed_form: bool = False,
) -> PipelineModel:
    """Pipeline from raw text to an unclipped ``prediction``; ``closed_form`` for small vocabularies."""
    train = train.select(text, label).na.drop()
    stages = feature_stages(train, text, max_features)
    counter = next(s for s in stages if isinstance(s, CountVectorizerModel))
    features = F.unwrap_udt("features")
    rows = (
        PipelineModel(stages)
        .transform(train)
        .select(
            features["indices"].alias("indices"),
            features["values"].alias("values"),
            F.col(label).cast("double").alias("label"),
        )
    )
    solve = normal_equations if closed_form else ridge
    coefs, intercept, _ = solve(rows, len(counter.vocabulary), alpha)
    return PipelineModel([*stages, linear_model(coefs, intercept)])


def optimality(
    model: PipelineModel, train: DataFrame, label: str = "target", alpha: float = fv.RIDGE_ALPHA
) -> DataFrame:
    """(largest_gradient, mean_residual, unit_vectors) of a fitted model on its training rows: the
    largest absolute entry of half the gradient of the penalised squares, the mean of prediction
    minus label, and the share of vectors of length 1 among those that are not empty. The texts are read
    once: a row also counts for the numbers -1 and, unless it is empty, -2 or (of length 1) -3."""
    linear = model.stages[-1]
    coefs = np.concatenate([np.zeros(3), linear.coefficients.toArray()])
    weights = train.sparkSession.createDataFrame(pa.table({"feature": np.arange(-3, linear.numFeatures), "coef": coefs}))
    features = F.unwrap_udt("features")
    rows = model.transform(train.filter(F.col(label).isNotNull())).select(
        features["indices"].alias("i"),
        features["values"].alias("v"),
        (F.col("prediction") - F.col(label)).alias("residual"),
    )
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    unit = F.when(F.abs(squares - 1) < 1e-9, -3).otherwise(-2)
    others = F.when(F.size("v") > 0, F.array(F.lit(-1), unit)).otherwise(F.array(F.lit(-1)))
    entries = F.arrays_zip(F.concat("i", others).alias("i"), F.concat("v", F.array_repeat(F.lit(1.0), 2)).alias("v"))
    products = (
        inline_rows(rows, ["residual"], entries, "i")
        .groupBy(F.col("i").cast("long").alias("feature"))
        .agg(F.sum(F.col("v") * F.col("residual")).alias("product"), F.count("*").alias("n"))
    )
    found = weights.join(products, "feature", "left").withColumns(
        {"product": F.coalesce("product", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))}
    )

    def of(number: int, column: str) -> Column:
        return F.sum(F.when(F.col("feature") == number, F.col(column)).otherwise(0))

    return found.agg(
        F.try_divide(of(-1, "product"), of(-1, "n")).alias("mean_residual"),
        F.try_divide(of(-3, "n"), of(-2, "n") + of(-3, "n")).alias("unit_vectors"),
        F.max(F.when(F.col("feature") >= 0, F.abs(F.col("product") + alpha * F.col("coef")))).alias("largest_gradient"),
    )


def score(model: PipelineModel, sentences: DataFrame, column: str = "local_score") -> DataFrame:
    scored = model.transform(sentences)
    return scored.drop("features").withColumnRenamed("prediction", column)


def coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, coef) of a fitted pipeline; ``df`` only names the session.

    The rows are the model's own parameters, at most ``max_features`` of them.
    """
    names = next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
    weights = model.stages[-1].coefficients.toArray()
    return df.sparkSession.createDataFrame(pa.table({"feature": names, "coef": weights}))


def extreme_coefficients(coefs: DataFrame, k: int = fv.TOP_COEFFICIENTS) -> DataFrame:
    """(feature, coef, position, side): the k largest and the k smallest coefficients, the position
    from 1, ties by term. Coefficients that differ by rounding errors only are ties."""
    sides, value = [], F.round("coef", TIE_DIGITS)
    for side, order in (("higher", value.desc()), ("lower", value.asc())):
        rows = coefs.orderBy(order, "feature").limit(k)
        position = F.row_number().over(W.orderBy(order, "feature"))  # of k rows
        sides.append(rows.withColumns({"position": position, "side": F.lit(side)}))
    return sides[0].unionByName(sides[1])


def identity_coefficients(
    coefs: DataFrame, lexicon: Mapping[str, Sequence[str]] = fv.LEXICON
) -> DataFrame:
    """Coefficients of the lexicon's words, with their group."""
    groups = {}
    for group, terms in lexicon.items():
        for term in terms:
            groups.setdefault(term.lower(), []).append(group)
    owner = F.coalesce(
        *[
            F.when(F.col("feature") == term, F.array(*[F.lit(g) for g in members]))
            for term, members in groups.items()
        ]
    )
    return coefs.filter(F.col("feature").isin(list(groups))).select(
        F.explode(owner).alias("identity"), "feature", "coef"
    )
