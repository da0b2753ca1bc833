"""Line deduplication by a tree of log templates.

A line is led through a tree of fixed depth: number of tokens, then its first DEPTH tokens
(tokens with digits count as variable). In a leaf that many documents reach, a token is fixed
where at least `min_docs` documents have it at that place, other places are variable fields.
The line's template is its fixed tokens with fields between. Lines whose template is at least
half fixed and recurs in `min_docs` documents are dropped, wherever they stand. Lines of LONG_TOKENS
tokens or more, which do not recur by chance, need LONG_DOCS documents in all these places.

Only DataFrame functions are used. The first scan turns lines into hashes (leaf, line); all counting
happens on them. A leaf with a single distinct line needs no more: all its tokens recur as often as
the line. Only of leaves with several distinct lines the tokens are fetched, once for each distinct
line. Texts that hold no such line, and at the end texts that lose no line, are kept out of the
shuffles by bitmaps of fixed size; the fuller a bitmap is, the more texts pass it, and the joins
behind it decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.bitmaps import bitmap, marked, only_marked
from evenhand.llm.common import checkpoint, lookup

DEPTH = 3
MIN_DOCS = 10
LONG_TOKENS = 20
LONG_DOCS = 2
FIXED_SHARE = 0.5
FIELD = "<*>"
BITS = 1 << 22  # of a bitmap of texts


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def plain_lines(text: Column) -> Column:
    """Lines with single blanks between tokens; those with a digit are a field. Every expression
    looks at a character a bounded number of times, also in a line without a blank."""
    odd = r" *+[\t\r\f\x0B][ \t\r\f\x0B]*+|  ++"
    clean = F.when(text.rlike(odd), F.regexp_replace(text, odd, " ")).otherwise(text)

    def plain(line: Column) -> Column:
        fields = F.transform(F.split(line, " "), lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))
        return F.when(line.rlike("[0-9]"), F.array_join(fields, " ")).otherwise(line)

    trimmed = F.transform(lines(clean), lambda line: F.trim(line))
    return F.transform(trimmed, plain)


def mark(line: Column) -> Column:
    """(leaf, line, dense) of a plain line: hashes, the leaf's odd for long lines, and whether enough
    tokens are no fields; null for blank lines."""
    count = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    even = F.xxhash64(count, F.substring_index(line, " ", DEPTH)).bitwiseAND(F.lit(-2))
    fields = F.size(F.filter(F.split(line, " "), lambda t: t == FIELD))
    fields = F.when(F.contains(line, F.lit(FIELD)), fields).otherwise(0)
    return F.when(
        line != "",
        F.struct(
            (even + F.when(count >= LONG_TOKENS, 1).otherwise(0)).alias("leaf"),
            F.xxhash64(line).alias("line"),
            (count - fields >= FIXED_SHARE * count).alias("dense"),
        ),
    )


def different(values: Column) -> Column:
    """The distinct values of an array, by sorting it."""

    def firsts(t: Column) -> Column:
        return F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1)))

    return F.get(F.transform(F.array(F.sort_array(values)), firsts), F.lit(0))


def needed(min_docs: int | None) -> Column:
    """Documents in which something of a `leaf` has to recur."""
    long_line = F.col("leaf").bitwiseAND(F.lit(1)) == 1
    return F.when(long_line, LONG_DOCS).otherwise(MIN_DOCS) if min_docs is None else F.lit(min_docs)


def line_tokens(keyed: DataFrame, distinct: DataFrame) -> DataFrame:
    """(leaf, line, docs, uses, tokens): hashes of the tokens of distinct lines, from one text that
    holds each; fields are null."""
    entry = F.struct("line", F.struct("docs", "uses"))
    wanted = distinct.groupBy(F.col("holder").alias("key")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("wanted")
    )
    wanted = checkpoint(wanted)
    held = only_marked(keyed, "key", bitmap(wanted, "key", BITS), BITS)
    texts = held.groupBy("key").agg(F.first("text").alias("text"))
    held = texts.join(wanted, "key").select("wanted", F.explode(plain_lines(F.col("text"))).alias("plain"))
    lines_of = held.select("wanted", "plain", mark(F.col("plain")).alias("m")).filter("m is not null")
    found = lines_of.select(
        "m.leaf", "m.line", "plain", F.try_element_at("wanted", F.col("m.line")).alias("own")
    ).filter("own is not null")
    token = lambda t: F.when(t != FIELD, F.xxhash64(t))
    return (
        found.select("leaf", "line", "own.docs", "own.uses", F.transform(F.split("plain", " "), token).alias("tokens"))
        .groupBy("leaf", "line")  # a text may hold the line twice
        .agg(*[F.first(c).alias(c) for c in ("docs", "uses", "tokens")])
    )


def template_lines(tokens: DataFrame, min_docs: int | None) -> DataFrame:
    """(line, uses) of the lines whose template is fixed enough and recurs."""
    tokens = checkpoint(tokens)
    size = F.size("tokens").alias("size")
    places = tokens.select("leaf", "line", "docs", size, F.posexplode("tokens").alias("place", "token"))
    places = places.filter("token is not null")
    common = places.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("seen"))
    common = common.filter(F.col("seen") >= needed(min_docs)).drop("seen")
    fixed = places.join(common, ["leaf", "place", "token"]).groupBy("leaf", "line", "docs", "size")
    shaped = checkpoint(
        fixed.agg(F.bit_xor(F.xxhash64("place", "token")).alias("template"), F.count("*").alias("fixed"))
        .filter(F.col("fixed") >= FIXED_SHARE * F.col("size"))
        .select("leaf", "line", "docs", "template", "fixed")
    )
    recurring = shaped.groupBy("leaf", "template", "fixed").agg(F.sum("docs").alias("all"))
    recurring = recurring.filter(F.col("all") >= needed(min_docs)).drop("all")
    bad = shaped.join(recurring, ["leaf", "template", "fixed"], "left_semi").select("leaf", "line")
    return tokens.select("leaf", "line", "uses").join(bad, ["leaf", "line"], "left_semi").select("line", "uses")


def dropped_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int | None = None
) -> DataFrame:
    """(key, n, bad): by text key, the hashes of the lines to drop; n rows have that text."""
    keyed = docs.select(F.col(text).alias("text")).filter("text is not null")
    keyed = keyed.select(key_of(F.col("text")).alias("key"), "text")
    marks = F.transform(plain_lines(F.col("text")), mark)
    texts = checkpoint(
        keyed.select("key", different(F.array_compact(marks)).alias("marks"))
        .groupBy("key")
        .agg(F.first("marks").alias("marks"), F.count("*").alias("n"))
    )
    # `uses` counts texts by leaf or line; it only moves the hot border
    leaves = texts.select("n", F.explode(F.array_distinct(F.col("marks.leaf"))).alias("leaf"))
    common = checkpoint(
        leaves.groupBy("leaf")
        .agg(F.sum("n").alias("docs"), F.count("*").alias("uses"))
        .filter(F.col("docs") >= needed(min_docs))
        .select("leaf", "uses")
    )
    own = texts.select("key", "n", F.inline("marks"))
    common = common.withColumn("common", F.lit(True))
    candidates = checkpoint(lookup(own, common, "leaf", "uses", ["key", "line"], "inner").drop("common"))
    distinct = checkpoint(
        candidates.groupBy("leaf", "line", "dense").agg(
            F.sum("n").alias("docs"), F.count("*").alias("uses"), F.min("key").alias("holder")
        )
    )
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("n"))
    alone = distinct.join(leaves.filter("n = 1"), "leaf", "left_semi").filter("dense").select("line", "uses")
    several = distinct.join(leaves.filter("n > 1"), "leaf", "left_semi")
    bad = alone.unionByName(template_lines(line_tokens(keyed, several), min_docs))
    bad = checkpoint(bad.withColumn("bad", F.col("line")))
    found = lookup(candidates.select("key", "n", "line"), bad, "line", "uses", ["key"], "inner")
    return found.groupBy("key").agg(F.first("n").alias("n"), F.collect_set("bad").alias("bad"))


def drop_template_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), one row per row of `docs`.

    Lines end at newlines; blank lines are never dropped. A null text stays null with no lines,
    an empty one has one blank line. `min_docs`, if given, holds for lines of any length. Rows of equal text lose equal lines and count as so many
    documents. Ids are only carried along. An empty table gives no rows.
    """
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), key_of(F.col(text)).alias("key"))
    bad = checkpoint(dropped_lines(docs, id, text, min_docs))
    source = marked(source, "key", checkpoint(bitmap(bad, "key", BITS)), BITS, "touched")
    touched = F.col("touched") & F.col("text").isNotNull()
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines(F.col("text")))).cast("long")
    same = source.filter(~touched).select("doc_id", "text", size.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    joined = lookup(source.filter(touched).drop("touched"), bad, "key", "n", ["doc_id"])
    which = F.transform(plain_lines(F.col("text")), lambda line: F.array_contains(F.col("bad"), F.xxhash64(line)))
    split = joined.select("doc_id", "text", "bad", lines(F.col("text")).alias("lines"), which.alias("drop"))
    kept = F.filter("lines", lambda line, i: ~F.get(F.col("drop"), i))
    gone = F.size(F.filter("drop", lambda d: d))
    cut = split.select(
        "doc_id",
        F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("bad").isNull(), 0).otherwise(gone).cast("long").alias("n_dropped"),
    )
    return same.unionByName(cut)
