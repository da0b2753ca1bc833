"""How filters interact: what each removes, alone and after every set of others, in any order.

Every filter has a posting list of the ids that fail it, in order, for each part of the table and
each range of ids. What a filter removes after others is the difference of its list and the union of
theirs; unions are k-way merges that gallop (steps double until the next id of another list is
passed, then bisect) and copy whole runs. Ranges and parts are disjoint, so sizes are summed over
ranges, and sizes for each filter and set of others give every order's numbers.

One scan of the texts measures the filters that look at one document. A text that a smaller id
has already is found without a join: the smallest id of every text is grouped out (combined before
the shuffle, so a text that a third of all rows share is no hot key) and sent, like the labels,
to the range of its id.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import checkpoint

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"
RANGE_BITS = 12  # ids of a range share all but these low bits
CAPITALS = bytes(range(65, 91))
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes that begin no character
FIRST, LABEL, ROW = 0, 1, 2
GOOD, TOXIC = 1, 2


def gallop(ids: Sequence[int], x: int, at: int) -> int:
    """First place from ``at`` on whose id is not below x."""
    step, size = 1, len(ids)
    while at + step < size and ids[at + step] < x:
        at += step
        step *= 2
    return bisect_left(ids, x, at, min(at + step, size))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """One sorted list of the ids in any of several: the list with the smallest head gives all ids
    below the next smallest head at once."""
    left = [(ids, 0) for ids in lists if ids]
    out: list[int] = []
    while len(left) > 1:
        left.sort(key=lambda l: l[0][l[1]])
        (ids, at), (others, place) = left[0], left[1]
        limit = others[place]
        end = gallop(ids, limit, at)
        out += ids[at:end]
        end += end < len(ids) and ids[end] == limit  # the other list has it too
        left[0] = (ids, end)
        if end == len(ids):
            del left[0]
    for ids, at in left:
        out += ids[at:]
    return out


def difference(ids: Sequence[int], others: Sequence[int]) -> list[int]:
    """Ids of the first sorted list that are not in the second."""
    out: list[int] = []
    at = place = 0
    while at < len(ids):
        place = gallop(others, ids[at], place)
        if place == len(others):
            out += ids[at:]
            break
        end = gallop(ids, others[place], at)
        out += ids[at:end]
        at = end + (end < len(ids) and ids[end] == others[place])
    return out


def failures(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()  # of bytes: at 0x20 and 0x09 to 0x0D
    few = len(words) < LEAST_WORDS
    repeated = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    chars = len(raw.translate(None, FOLLOWING))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    marked = len(raw.translate(None, MARKS)) < len(raw)
    return few | repeated << 1 | (100 * capitals > CAPITAL_PERCENT * chars) << 2 | marked << 3


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bits, digest) of every document: its failures and its text's SHA-256."""

    def run(batches):
        for batch in batches:
            bits, digests = [], []
            for value in batch.column(2):
                raw = value.as_py() or b""
                bits.append(failures(raw))
                digests.append(hashlib.sha256(raw).digest())
            arrays = [batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "bits", "digest"])

    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("binary"),
    )
    return rows.mapInArrow(run, "doc_id long, part string, bits int, digest binary")


def streams(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(span, kind, doc_id, part, bits, digest, n): documents, first ids of texts and labels, dealt
    by their range of ids. Documents without an id are spread; equal rows are counted."""
    columns = ["doc_id", "kind", "part", "bits", "digest"]
    nothing = F.lit(None)
    rows = measured.withColumn("kind", F.lit(ROW))
    firsts = measured.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    firsts = firsts.withColumns({"kind": F.lit(FIRST), "part": nothing.cast("string"), "bits": nothing.cast("int")})
    marks = labels.select(
        F.col("doc_id").cast("long"),
        F.lit(LABEL).alias("kind"),
        nothing.cast("string").alias("part"),
        (
            F.when(F.col("quality") == 1, GOOD).otherwise(0) + F.when(F.col("toxic") == 1, TOXIC).otherwise(0)
        ).alias("bits"),
        nothing.cast("binary").alias("digest"),
    ).filter("doc_id is not null and bits > 0")
    spread = F.xxhash64(F.monotonically_increasing_id())
    rows = rows.withColumn("span", F.coalesce(F.shiftright("doc_id", RANGE_BITS), spread))
    others = firsts.select(*columns).unionByName(marks)
    others = others.withColumn("span", F.shiftright("doc_id", RANGE_BITS))
    every = rows.select("span", *columns).unionByName(others.select("span", *columns))
    return every.repartition("span").groupBy("span", *columns).agg(F.count("*").alias("n"))


def cell(filter_no: int, earlier: int) -> int:
    """Place of what a filter removes after a set of others; unions' sizes follow all of these."""
    return filter_no * SETS + earlier


ROWS = cell(len(FILTERS), 0)  # the union of no filter: here, all rows


def count_span(table: pa.Table) -> pa.Table:
    """(part, cell, removed, good, toxic) for the parts of one range of ids, without zeros."""
    firsts, labels, rows = set(), {}, {}
    for kind, key, part, bits, digest, n in zip(*(table[c].to_pylist() for c in ("kind", "doc_id", "part", "bits", "digest", "n"))):
        if kind == FIRST:
            firsts.add((key, digest))
        elif kind == LABEL:
            labels[key] = labels.get(key, 0) | bits
        else:
            rows.setdefault(part, []).append((key is None, key or 0, digest, bits, n))
    out: list[tuple] = []
    for part, own in rows.items():
        own.sort()
        # Ids inside the part and range: places in the order of doc_id, so repeated ids stay apart.
        known = [i for i, row in enumerate(own) if not row[0]]
        lists = [[i for i, row in enumerate(own) if row[3] >> f & 1] for f in range(len(FILTERS) - 1)]
        lists.append(difference(known, [i for i in known if own[i][1:3] in firsts]))
        good, toxic = ([i for i in known if labels.get(own[i][1], 0) & bit] for bit in (GOOD, TOXIC))
        weights = None if all(row[4] == 1 for row in own) else [row[4] for row in own]

        def size(ids, weights=weights):
            return len(ids) if weights is None else sum(weights[i] for i in ids)

        def shares(ids, good=good, toxic=toxic):
            whole = size(ids)
            return whole, whole - size(difference(ids, good)), whole - size(difference(ids, toxic))

        out.append((part, ROWS, size(range(len(own))), 0, 0))
        unions = [union([lists[f] for f in range(len(FILTERS)) if chosen >> f & 1]) for chosen in range(SETS)]
        for chosen in range(1, SETS):
            if unions[chosen]:
                out.append((part, ROWS + chosen, size(unions[chosen]), 0, 0))
        for f, ids in enumerate(lists):
            for earlier in range(SETS):
                if ids and not earlier >> f & 1 and (removed := difference(ids, unions[earlier])):
                    out.append((part, cell(f, earlier), *shares(removed)))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
    return pa.Table.from_arrays(arrays, ["part", "cell", "removed", "good", "toxic"])


def sizes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each part an array with (removed, good, toxic) at ``cell(f, earlier)`` and
    the size of the union of a set of filters at ``ROWS + set``, the part's rows at ``ROWS``."""
    measured = checkpoint(measure(docs))
    schema = "part string, cell int, removed long, good long, toxic long"
    counted = streams(measured, labels).groupBy("span").applyInArrow(count_span, schema)
    summed = counted.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])
    entry = F.struct("cell", F.struct("removed", "good", "toxic"))
    found = summed.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("found"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("removed", "good", "toxic")])
    every = F.sequence(F.lit(0), F.lit(ROWS + SETS - 1))
    cells = F.transform(every, lambda i: F.coalesce(F.try_element_at("found", i), zero))
    return found.select("part", cells.alias("cells"))


def set_of(letters: Column) -> Column:
    return reduce(add, [F.when(F.contains(letters, F.lit(x)), 1 << f).otherwise(0) for f, x in enumerate(FILTERS)])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for every part, order of the filters and step.

    ``docs`` has (doc_id, text, source), ``labels`` (doc_id, quality, toxic); other columns are not
    read. A null text counts as empty, a null source is the part ''. Every row counts, repeated ones
    too; of equal texts only rows with a doc_id above the text's smallest fail E, so rows that repeat
    the smallest id and rows without an id never do. A document is good or toxic if any of its label
    rows says so; labels without a document or id count nowhere. No documents give no rows.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))

    def at(place: Column | int, field: str = "removed") -> Column:
        return F.get("cells", F.lit(place) if isinstance(place, int) else place)[field]

    def shapley(f: int) -> Column:
        terms = []
        for earlier in range(SETS):
            if not earlier >> f & 1:
                n = earlier.bit_count()
                terms.append(at(cell(f, earlier)) * (factorial(n) * factorial(len(FILTERS) - 1 - n)))
        return reduce(add, terms)

    parts = sizes(docs, labels).select("*", F.array(*[shapley(f) for f in range(len(FILTERS))]).alias("over_orders"))
    listed = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(steps).alias("step"))
    before = set_of(F.expr("substring(filter_order, 1, step - 1)"))
    letter = F.expr("substring(filter_order, step, 1)")
    number = F.instr(F.lit(FILTERS), letter) - 1
    listed = listed.withColumns({"filter": letter, "f": number, "earlier": before})
    own = F.expr("shiftleft(1, f)")
    place = F.col("f") * SETS + F.col("earlier")
    alone = F.col("f") * SETS + (SETS - 1 - own)
    return listed.select(
        "part",
        "filter_order",
        "step",
        "filter",
        (at(ROWS) - at(F.lit(ROWS) + F.col("earlier") + own)).alias("kept"),
        at(place).alias("removed"),
        (at(F.col("f") * SETS) - at(place)).alias("redundant"),
        at(alone).alias("unique_fails"),
        at(place, "good").alias("good_lost"),
        at(place, "toxic").alias("toxic_lost"),
        F.get("over_orders", F.col("f")).alias("shapley"),
    )


#: The same rows from a count of documents by the filters they fail.
ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), firsts AS (
  SELECT body, min(doc_id) AS first_id FROM cut GROUP BY body
), flagged AS (
  SELECT c.doc_id, c.part,
         (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN c.doc_id > f.first_id THEN 16 ELSE 0 END) AS bits
  FROM cut c JOIN firsts f USING (body)
), marked AS (
  SELECT d.part, d.bits, count(*) AS n,
         count(*) FILTER (WHERE l.good) AS good, count(*) FILTER (WHERE l.toxic) AS toxic
  FROM flagged d LEFT JOIN (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
  ) l USING (doc_id) GROUP BY d.part, d.bits
), letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, s.step, bits[s.step] AS own, list_sum(bits[1:s.step]) - bits[s.step] AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s
), counted AS (
  SELECT m.part, s.filter_order, CAST(s.step AS INTEGER) AS step, substr(s.filter_order, s.step, 1) AS "filter",
         CAST(coalesce(sum(n) FILTER (WHERE m.bits & (s.earlier + s.own) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE m.bits & s.own > 0 AND m.bits & s.earlier = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE m.bits & s.own > 0 AND m.bits & s.earlier > 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE m.bits = s.own), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE m.bits & s.own > 0 AND m.bits & s.earlier = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE m.bits & s.own > 0 AND m.bits & s.earlier = 0), 0) AS BIGINT) AS toxic_lost
  FROM marked m, steps s GROUP BY m.part, s.filter_order, s.step
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, "filter") AS BIGINT) AS shapley FROM counted
"""
