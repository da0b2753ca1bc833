"""I-Match fingerprints: hashes of the distinct mid-frequency terms of a document.

Terms whose document frequency lies in a band form the lexicon; a term in few documents is noise,
one in most says nothing. As one changed term changes the hash of all terms, `SUBSETS` lexicons
are drawn from it at random (a term's hash decides), and each gives a hash of the distinct terms
of the document that it holds, sorted. Two fingerprints are as alike as the share of equal hashes.

A document that fills fewer than half of these subsets has a second part: `SUBSETS` denser draws
from the band and the terms above it. Two such documents are as alike as the better part says.

The band's lower end bounds the lexicon: at most (mean distinct terms) / `LOW` terms are in as
large a share of the documents, whatever their number, and all of them are kept. They are dealt
by hash into short arrays in every row's expression, so texts are not shuffled for them and a term
is compared with a few others only. All steps are DataFrame functions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.common import checkpoint, text_key

LOW, HIGH = 0.004, 0.05
SUBSETS = 16
#: A term is in a given subset with this probability, in thousandths: with the whole band about one
#: and a half terms of a typical document.
PER_MILLE = 18
#: The same for the second part.
DENSE_PER_MILLE = 200
#: Mean number of terms in an array of the lexicon.
BUCKET_TERMS = 2


def terms(text: Column) -> Column:
    """Distinct lower-case words (runs without ASCII punctuation or blanks) of a whole text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.array_distinct(words)


def lexicon(
    docs: DataFrame,
    text: str = "text",
    low: float = LOW,
    high: float = HIGH,
    size: int | None = None,
    *,
    common: bool = False,
) -> DataFrame:
    """(term, band): the terms in a share [low, high] of the documents, with `common` also those in
    more, which are not of the band. Only the `size` rarest, if given."""
    frequency = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n")).scalar()
    frequent = frequency.filter((F.col("df") >= F.greatest(low * total, F.lit(2))) & (F.col("term") != ""))
    frequent = frequent.withColumn("band", F.col("df") <= high * total)
    if not common:
        frequent = frequent.filter("band")
    if size is not None:
        frequent = frequent.orderBy("df", "term").limit(size)
    return frequent.select("term", "band")


def holder(words: DataFrame) -> Callable[[Column], Column]:
    """A function of an array of terms: those that are a `term` of `words`, sorted."""
    buckets = max(1, words.count() // BUCKET_TERMS)
    bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")
    dealt = [[] for _ in range(buckets)]
    for row in words.select("term", bucket(F.col("term")).alias("id")).orderBy("term").collect():
        dealt[row["id"]].append(row["term"])
    # a constant of the plan: subqueries are not allowed in the function of a filter
    arrays = F.from_json(F.lit(json.dumps(dealt)), "array<array<string>>")
    return lambda found: F.sort_array(
        F.filter(found, lambda t: F.array_contains(F.get(arrays, bucket(t)), t))
    )


def marked_terms(found: Column) -> Column:
    """The terms, each with a hash from which its subsets are drawn."""
    return F.transform(found, lambda t: F.struct(t.alias("t"), F.xxhash64(t, F.lit("lexicon")).alias("h")))


def hashes(marked: Column, per_mille: int = PER_MILLE) -> Column:
    """Array of SUBSETS hashes of the terms drawn, null where a subset has none of them."""

    def one(k: int) -> Column:
        inside = F.filter(marked, lambda x: F.pmod(F.xxhash64(x["h"], F.lit(k)), F.lit(1000)) < per_mille)
        return F.nullif(F.array_join(F.transform(inside, lambda x: x["t"]), " "), F.lit(""))

    return F.transform(F.array(*[one(k) for k in range(SUBSETS)]), lambda x: F.substring(F.md5(x), 1, 8))


def filled(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda p: p.isNotNull()))


def printed(text: Column, parts: Column, dense: Column) -> Column:
    """The fingerprint as a string: the hashes, `-` for an empty subset, a second part after `/` if
    `dense` is not null, or the hash of the text."""
    none = (filled(parts) == 0) & (F.coalesce(filled(dense), F.lit(0)) <= 0)
    whole = F.concat(F.lit("text:"), text_key(F.coalesce(text, F.lit(""))))
    both = F.concat_ws("/", F.array_join(parts, ".", "-"), F.array_join(dense, ".", "-"))
    return F.when(none, whole).otherwise(both)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that are not empty in both, of the part where it is
    larger; 1 for equal prints."""

    def alike(part: int) -> Column:
        x, y = (F.split(F.get(F.split(c, "/"), F.lit(part)), r"\.") for c in (a, b))
        pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] != "-") | (p["y"] != "-"))
        equal = F.size(F.filter(pairs, lambda p: p["x"].eqNullSafe(p["y"])))
        return F.when(F.size(pairs) > 0, equal / F.size(pairs)).otherwise(0.0)

    text_only = a.startswith("text:") | b.startswith("text:")
    two = a.contains("/") & b.contains("/")
    best = F.when(two, F.greatest(alike(0), alike(1))).otherwise(alike(0))
    return F.when(a == b, 1.0).when(text_only, 0.0).otherwise(best)


SLICE_ROWS = 2_000
SLICES = 20_000


def in_slices(docs: DataFrame) -> DataFrame:
    """`docs` with a column `slice`: ascending ranges of doc_id between quantiles, so a slice is a
    bounded part of the table. Null ids are in the first one."""
    slices = max(1, min(SLICES, docs.count() // SLICE_ROWS))
    shares = [i / slices for i in range(1, slices)]
    if not shares:
        return docs.withColumn("slice", F.lit(0))
    ids = F.col("doc_id").cast("long")
    docs = docs.withColumn("borders", docs.select(F.percentile_approx(ids, shares, 100 * slices)).scalar())
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(slices.bit_length()))])
    place = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: at + F.when(F.get("borders", at + step - 1) <= ids, step).otherwise(F.lit(0)),
    )
    return docs.withColumn("slice", place).drop("borders")


def fingerprint_pairs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has its last floor(n / 4) code points replaced by as many of the next
    document. A null text is empty; equal texts have equal fingerprints; a text without any term
    of the lexicon or above it has a fingerprint of its own. Ids may be null (first) or repeated (ordered
    by text hash). A single document follows itself; an empty table gives no rows.
    """
    source = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = checkpoint(lexicon(source, common=True))
    in_band, above = holder(words.filter("band")), holder(words.filter("not band"))
    sliced = in_slices(source.withColumn("key", F.md5(F.encode("text", "UTF-8"))))
    place = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("key"))
    first = sliced.groupBy("slice").agg(F.min_by(F.struct("doc_id", "key"), place).alias("head"))
    # one row per slice; a slice is followed by the first row of the next, the last by that of the first
    order = W.orderBy("slice")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = first.select("head", F.coalesce(F.lag("slice").over(order), F.max("slice").over(whole)).alias("to"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("key") == F.col("head.key"))
    ghosts = sliced.join(F.broadcast(heads), is_head)
    both = sliced.select("doc_id", "text", "key", "slice", F.lit(0).alias("ghost")).union(
        ghosts.select("doc_id", "text", "key", "to", F.lit(1))
    )
    by = W.partitionBy("slice").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "key")
    paired = both.withColumns({"n_chars": F.char_length("text").cast("long"), "next": F.lead("text").over(by)})
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut),
        F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut),
    )
    own = ["doc_id", "slice", "ghost", "key", "n_chars"]
    paired = paired.select(*own, "text", edited.alias("edited"))
    marked = paired.select(
        *own,
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "text",
        "edited",
        terms(F.col("text")).alias("terms"),
        terms(F.col("edited")).alias("edited_terms"),
    )
    made = marked
    for c in ("terms", "edited_terms"):
        made = made.withColumns({f"{c}_band": in_band(F.col(c)), f"{c}_above": above(F.col(c))}).drop(c)
    made = made.withColumns({f"{c}_band": marked_terms(F.col(f"{c}_band")) for c in ("terms", "edited_terms")})
    made = made.withColumns({f"{c}_parts": hashes(F.col(f"{c}_band")) for c in ("terms", "edited_terms")})
    for c in ("terms", "edited_terms"):
        every = F.concat(f"{c}_band", marked_terms(F.col(f"{c}_above")))
        poor = filled(F.col(f"{c}_parts")) < SUBSETS // 2
        made = made.withColumn(f"{c}_dense", F.when(poor, hashes(every, DENSE_PER_MILLE)))
    made = made.select(
        *own,
        "edited_sha256",
        printed(F.col("text"), F.col("terms_parts"), F.col("terms_dense")).alias("fingerprint"),
        printed(F.col("edited"), F.col("edited_terms_parts"), F.col("edited_terms_dense")).alias("edited_fingerprint"),
    )
    made = made.withColumn("next", F.lead("fingerprint").over(by)).filter("ghost = 0")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
