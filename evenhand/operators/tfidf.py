"""Corpus TF-IDF as long tables (key, term, value).

Documents enter as (key, text); a key must identify one document. Counting terms inside a
document needs no shuffle, because a document is one row. Only the document frequencies
(combined before the shuffle) and the look-up of a pair's frequency move data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand import fixed_values as fv
from evenhand.functions.bitmaps import bitmap, only_marked
from evenhand.functions.numbers import strict_number, strip
from evenhand.functions.text import clean_tokens, term_runs
from evenhand.functions.unnest import explode_rows, inline_rows
from evenhand.sources.shared import checkpointed

KEY_BITS = 1 << 20  # of the bitmap of requested keys
TERM_BITS = 1 << 22  # of the bitmap of requested terms
HOT_TERMS = 10_000  # a term of over 1 / HOT_TERMS of all pairs is hot: at most so many are


def document_frequency(
    docs: DataFrame,
    text: str = "comment_text",
    min_df: int = fv.MIN_DOC_FREQ,
    stopwords: Sequence[str] = fv.STOPWORDS,
    among: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(term, df): documents that contain the term, rare terms dropped; ``among`` may leave terms
    out before anything is shuffled."""
    distinct = F.array_distinct(clean_tokens(F.col(text), stopwords))
    terms = explode_rows(docs, [], distinct, "term")
    if among is not None:
        terms = among(terms)
    return (
        terms.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    )


def corpus_stats(docs: DataFrame, frequency: DataFrame) -> DataFrame:
    """One row: number of documents (empty ones included) and vocabulary size."""
    return docs.agg(F.count("*").alias("n_docs")).withColumn(
        "vocabulary", frequency.agg(F.count("*")).scalar()
    )


def term_counts(
    docs: DataFrame,
    key: str = "id",
    text: str = "comment_text",
    keep: Sequence[str] = (),
    keep_empty: bool = False,
    stopwords: Sequence[str] = fv.STOPWORDS,
) -> DataFrame:
    """(key, *keep, doc_len, term, cnt). The length counts every kept token, also those of
    rare terms. ``keep_empty`` gives a document without tokens one row with a NULL term."""
    tokens = docs.select(key, *keep, clean_tokens(F.col(text), stopwords).alias("tokens"))
    runs = tokens.select(
        key,
        *keep,
        F.size("tokens").cast("long").alias("doc_len"),
        term_runs(F.col("tokens")).alias("runs"),
    )
    if keep_empty:
        return runs.select(key, *keep, "doc_len", F.inline_outer("runs"))
    return inline_rows(runs, [key, *keep, "doc_len"], F.col("runs"), "term")


def idf(df: Column, n_docs: Column) -> Column:
    """Smoothed inverse document frequency; an unknown term has frequency 0."""
    return F.ln((n_docs + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1


def tf(cnt: Column, doc_len: Column) -> Column:
    return cnt / F.greatest(doc_len, F.lit(1))


def with_frequency(
    pairs: DataFrame,
    frequency: DataFrame,
    key: str,
    hot_terms: int = HOT_TERMS,
) -> DataFrame:
    """Left join of (.., term, ..) to the document frequencies, robust to very common terms.

    A term may occur in a third of all documents, and all its pairs would meet in one task.
    Terms with more than 1 / hot_terms of all pairs, so at most ``hot_terms`` of whatever length,
    are broadcast as two hashes and a count. A pair of such a term takes its frequency from
    that list, and its key in the join by shuffle is a hash of the document and the term that no
    term equals, so it is spread over all partitions. Rows without a term are spread likewise.
    """
    total = frequency.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).scalar()
    hot = frequency.filter(F.col("df") > total / hot_terms).select(
        F.xxhash64("term").alias("__h1"),
        F.xxhash64("term", F.lit(1)).alias("__h2"),
        F.col("df").alias("hot_df"),
    )
    salt = F.concat(F.lit("#"), F.xxhash64(key, "term"))
    cold = F.col("hot_df").isNull() & F.col("term").isNotNull()
    is_hot = (F.xxhash64("term") == F.col("__h1")) & (F.xxhash64("term", F.lit(1)) == F.col("__h2"))
    salted = pairs.join(F.broadcast(hot), is_hot, "left").withColumn(
        "lookup", F.when(cold, F.col("term")).otherwise(salt)
    )
    return (
        salted.join(frequency.withColumnRenamed("term", "lookup"), "lookup", "left")
        .withColumn("df", F.coalesce("hot_df", "df"))
        .drop("lookup", "hot_df", "__h1", "__h2")
    )


def _n_docs(docs: DataFrame) -> Column:
    return docs.agg(F.count("*")).scalar()


def tfidf_long(
    docs: DataFrame,
    key: str = "id",
    text: str = "comment_text",
    keep: Sequence[str] = (),
    corpus: DataFrame | None = None,
    min_df: int = fv.MIN_DOC_FREQ,
    vocabulary: DataFrame | Sequence[str] | None = None,
    keep_empty: bool = False,
    stopwords: Sequence[str] = fv.STOPWORDS,
) -> DataFrame:
    """(key, *keep, term, tfidf) for every known term of every document.

    ``corpus`` supplies the frequencies when ``docs`` is only a part of it. ``vocabulary``
    is an optional list, or a table with a ``term`` column; None and an empty list mean no
    restriction. Documents without a known term appear only with ``keep_empty``, as a NULL
    term.
    """
    corpus = docs if corpus is None else corpus
    frequency = document_frequency(corpus, text, min_df, stopwords)
    if isinstance(vocabulary, Sequence):
        rows = [(term,) for term in vocabulary]
        vocabulary = docs.sparkSession.createDataFrame(rows, "term string") if rows else None
    if vocabulary is not None:
        # Restricting the one-row-per-term table restricts the pairs without another join.
        frequency = frequency.join(vocabulary.select("term"), "term", "left_semi")
    pairs = with_frequency(
        term_counts(docs, key, text, keep, keep_empty, stopwords), frequency, key
    )
    known = F.col("df").isNotNull()
    weight = tf(F.col("cnt"), F.col("doc_len")) * idf(F.col("df"), _n_docs(corpus))
    if not keep_empty:
        return pairs.filter(known).select(key, *keep, "term", weight.alias("tfidf"))
    return pairs.select(
        key, *keep, F.when(known, F.col("term")).alias("term"), F.when(known, weight).alias("tfidf")
    )


def vectors(
    docs: DataFrame,
    key: str = "id",
    text: str = "comment_text",
    target: str | None = "target",
    corpus: DataFrame | None = None,
    min_df: int = fv.MIN_DOC_FREQ,
    vocabulary: DataFrame | Sequence[str] | None = None,
) -> DataFrame:
    """(key, target, vec): one map of term weights per document, empty for no known term.

    A missing target is 0; a text target that is no number fails the job. Without a target
    the column is left out: one from another table is better joined to the vectors than to
    the texts.
    """
    if target is None:
        long = tfidf_long(docs, key, text, [], corpus, min_df, vocabulary, True)
        return long.groupBy(key).agg(_as_map())
    if docs.schema[target].dataType.typeName() == "string":
        value = strict_number(F.col(target))
    else:
        value = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    long = tfidf_long(
        docs.withColumn(target, value), key, text, [target], corpus, min_df, vocabulary, True
    )
    return long.groupBy(key, target).agg(_as_map())


def _as_map() -> Column:
    entries = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tfidf")))
    return F.map_from_entries(F.sort_array(entries)).alias("vec")


def top_terms(tfidf: DataFrame, key: str = "id", k: int = 3) -> DataFrame:
    """The k heaviest terms of each document, ties in term order."""
    order = W.partitionBy(key).orderBy(F.desc("tfidf"), "term")
    return tfidf.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def first_documents(docs: DataFrame, key: str = "id", n: int = 10) -> DataFrame:
    return docs.orderBy(key).limit(n)


def lookup(
    requests: DataFrame,
    docs: DataFrame,
    key: str = "id",
    text: str = "comment_text",
    min_df: int = fv.MIN_DOC_FREQ,
    salts: int = 16,
) -> DataFrame:
    """(key, term, tfidf) for each distinct request (key, term), 0.0 for an absent term.

    The requested term is lower-cased and stripped of white space, but not tokenised. A rare term counts
    with frequency 0. Requests for unknown documents are left out (``missing_documents``).
    A document that very many requests name is handled by salting the existence check; the
    look-up itself is keyed by document and term. Bitmaps of the requested keys and terms, of fixed size
    and read first, keep nearly all texts and terms that nobody asked for out of the shuffles.
    """
    wanted = requests.select(key, strip(F.lower("term")).alias("term")).distinct()
    keys = wanted.select(key).distinct()
    held = only_marked(docs, key, bitmap(keys, key, KEY_BITS), KEY_BITS)
    asked_docs = held.join(keys, key, "left_semi")
    counts = term_counts(asked_docs, key, text)
    existing = asked_docs.select(key, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    in_range = (
        wanted.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
        .join(existing, [key, "salt"], "left_semi")
        .drop("salt")
    )
    found = in_range.join(counts, [key, "term"], "left")
    weight = tf(F.col("cnt"), F.col("doc_len")) * idf(F.col("df"), _n_docs(docs))
    # Only requested terms are counted, in one scan; the table is used twice.
    asked = bitmap(wanted, "term", TERM_BITS)
    among = lambda terms: only_marked(terms, "term", asked, TERM_BITS)
    frequency = checkpointed(document_frequency(docs, text, min_df, among=among))
    return with_frequency(found, frequency, key).select(
        key, "term", F.coalesce(weight, F.lit(0.0)).alias("tfidf")
    )


def missing_documents(requests: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    return requests.select(key).distinct().join(docs.select(key), key, "left_anti")
