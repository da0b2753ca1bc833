"""SimHash near-duplicates by anchor-point covering.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of a text's
3-word shingles. Two fingerprints link at `max_bits` or fewer differing bits.

Search: of two linked fingerprints one 32-bit half differs in at most t = max_bits // 2 bits.
The anchors of a half are the codewords of the Hamming code [31, 26] over its lower 31 bits, a
perfect covering code of radius 1: every half has an anchor within 1 bit. A fingerprint is
copied to every anchor within radius + t = 2 bits, at most 16 of them, so two linked
fingerprints meet at the home anchor of either. Per anchor they are compared over all 64 bits.

Equal fingerprints are folded first. At an anchor a spanning forest of the links is kept, never
all pairs. Anchors with many fingerprints are cut into several tasks (see `_anchor_rows`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.common import checkpoint, lookup, text_key

SHINGLE = 3
MAX_BITS = 3
SEED = 42
CHUNK = 1 << 16
#: An anchor with more fingerprints than this is cut into tasks of about this size.
ANCHOR_ROWS = 8_192
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint of a whole text; 0 without words.

    bytes.lower() changes A-Z only and bytes.split() cuts at 09-0D and 20, as wanted.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros((8, 8), np.int64)
    for start in range(0, n, CHUNK):
        part = words[start : min(start + CHUNK, n) + SHINGLE - 1]
        if n == 1:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False))
        values = np.array([hashed(s, SEED) for s in shingles], np.uint64)
        octets = values.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            counts[byte] += np.bincount(octets[:, byte], minlength=256) @ _BYTE_BITS
    bits = (counts * 2 > n).astype(np.uint8).reshape(-1)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as signed long), one row per row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])

    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, fp long")


# ------------------------------------------------------------------ anchors


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: masks that turn a half into its anchors; the first is the home anchor."""
    bit = lambda place: 1 << (place - 1)  # noqa: E731  places 1 to 31
    masks = np.zeros((32, 16), np.uint32)
    counts = np.ones(32, np.int64)
    for syndrome in range(1, 32):
        pairs = [bit(i) | bit(i ^ syndrome) for i in range(1, 32) if i < i ^ syndrome]
        masks[syndrome] = [bit(syndrome), *pairs]
        counts[syndrome] = 16
    return masks, counts


MASKS, COUNTS = _tables()
PLACES = [int(sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1)) for b in range(5)]


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of `prints`, anchor key) for every anchor within 2 bits of either half."""
    rows, keys = [], []
    for side in range(2):
        half = (prints >> np.uint64(32 * side)).astype(np.uint32) & np.uint32(0x7FFFFFFF)
        syndrome = np.zeros(len(half), np.int64)
        for b, mask in enumerate(PLACES):
            syndrome |= (np.bitwise_count(half & np.uint32(mask)).astype(np.int64) & 1) << b
        all_keys = (half[:, None] ^ MASKS[syndrome]).astype(np.int64) | (side << 31)
        wanted = np.arange(16)[None, :] < COUNTS[syndrome][:, None]
        rows.append(np.nonzero(wanted)[0])
        keys.append(all_keys[wanted])
    return np.concatenate(rows), np.concatenate(keys)


def _anchor_rows(distinct: DataFrame) -> DataFrame:
    """(anchor, part, fp, home): each fingerprint at all its anchors.

    An anchor of n > ANCHOR_ROWS fingerprints has k = ceil(n / ANCHOR_ROWS) slices; the pairs
    of slices (i, j), i <= j, are its parts, and slice i goes to the k parts it occurs in. Each
    pair of fingerprints so meets in one part, and no part holds over about 2 ANCHOR_ROWS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(prints), CHUNK):
                part = prints[start : start + CHUNK]
                rows, keys = anchors(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(part[rows].view(np.int64))], ["anchor", "fp"]
                )

    placed = distinct.select("fp").mapInArrow(run, "anchor long, fp long")
    large = (
        placed.groupBy("anchor")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > ANCHOR_ROWS)
        .select("anchor", F.ceil(F.col("n") / ANCHOR_ROWS).cast("int").alias("k"))
    )
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("k")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda other: F.least(own, other) * F.col("k") + F.greatest(own, other),
    )
    cut = (
        placed.join(large, "anchor", "left")
        .withColumn("parts", F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(pairs))
        .select("anchor", "fp", F.explode("parts").alias("part"))
    )
    return cut


def _forest(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints of one anchor as all its links do."""
    left = np.arange(len(prints))
    ones, others = [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            near = np.bitwise_count(prints[left] ^ prints[node]) <= max_bits
            if near.any():
                new = left[near]
                left = left[~near]
                ones.append(np.full(len(new), node))
                others.append(new)
                frontier.extend(new)
    if not ones:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ones), np.concatenate(others)


SMALL = 12


def compare(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys. Runs up to SMALL are compared at once, by distance."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_at = np.repeat(sizes, sizes)
    ones, others = [], []
    small = np.flatnonzero((size_at > 1) & (size_at <= SMALL))
    for distance in range(1, SMALL):
        small = small[small + distance < len(keys)]
        small = small[keys[small] == keys[small + distance]]
        near = np.bitwise_count(prints[small] ^ prints[small + distance]) <= max_bits
        ones.append(small[near])
        others.append(small[near] + distance)
    for start, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        a, b = _forest(prints[start : start + n], max_bits)
        ones.append(a + start)
        others.append(b + start)
    a, b = np.concatenate(ones), np.concatenate(others)
    return prints[a], prints[b]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints `fp` that connect what all links do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys, prints):
            if len(keys) < 2:
                return None
            a, b = (x.view(np.int64) for x in compare(keys, prints, max_bits))
            if not len(a):
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            # one number per (anchor, part): parts beyond the first belong to rare, large anchors
            new = batch.column(0).to_numpy(zero_copy_only=False) + (
                batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << 32
            )
            keys = np.concatenate([keys, new])
            prints = np.concatenate([prints, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = len(keys) - int((keys == keys[-1]).sum()) if len(keys) else 0
            out = found(keys[:last], prints[:last])
            if out is not None:
                yield out
            keys, prints = keys[last:], prints[last:]
        out = found(keys, prints)
        if out is not None:
            yield out

    rows = _anchor_rows(distinct).select("anchor", "part", "fp").repartition("anchor", "part")
    return rows.sortWithinPartitions("anchor", "part").mapInArrow(run, "a long, b long").distinct()


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large and small stars.

    Every node's least neighbour comes from a grouping that is combined before its shuffle, and
    goes back to the edges by `lookup`, so the centre of a star burdens no task. Each round is
    checkpointed.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))

    def star(sides: DataFrame) -> DataFrame:
        least = checkpoint(
            sides.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select(
                "u", "n", F.least("u", "v").alias("m")
            )
        )
        return lookup(sides, least, "u", "n", ["v"]), least

    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        large, _ = star(both)
        edges = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(edges.filter("u <> v").distinct())
        small, least = star(edges)
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        edges = checkpoint(edges.filter("u <> v").distinct())
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id), one row per row of `docs`.

    `component_id` is the smallest id that can be reached by links; null ids are passed over,
    and a component of null ids only has a null one. Texts without words (null, empty, blank)
    have fingerprint zero and link like others. Repeated rows stay. An empty table gives no rows.
    """
    prints = checkpoint(fingerprints(docs, id, text))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    members = components(links(distinct, max_bits))
    roots = distinct.join(members, distinct["fp"] == members["node"], "left").select(
        "fp", "n", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    named = lookup(roots, checkpoint(ids), "root", "fps", ["fp"])
    named = checkpoint(named.select("fp", "n", "component_id"))
    return lookup(prints, named, "fp", "n", ["doc_id"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the document with the
    smallest id stays (null ids last, then the smallest text hash), of equal rows one."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"))
    keyed = keyed.select("row", F.col(f"row.`{id}`").alias("id"), text_key(F.col(f"row.`{text}`")).alias("key"))
    heads = keyed.select(F.struct("id", "key").alias("head"), F.col(f"row.`{text}`").alias("text"))
    prints = checkpoint(fingerprints(heads, "head", "text"))
    distinct = checkpoint(prints.groupBy("fp").agg(F.count("*").alias("n")))
    members = components(links(distinct))
    roots = checkpoint(
        distinct.join(members, distinct["fp"] == members["node"], "left").select(
            "fp", "n", F.coalesce("root", "fp").alias("root")
        )
    )
    first = F.struct(F.col("doc_id.id").isNull(), F.col("doc_id.id"), F.col("doc_id.key"))
    stay = (
        lookup(prints, roots, "fp", "n", ["doc_id"])
        .groupBy("root")
        .agg(F.min_by("doc_id", first).alias("head"))
        .select(F.col("head.id").alias("stay_id"), F.col("head.key").alias("stay_key"))
    )
    copies = prints.groupBy("doc_id").agg(F.count("*").alias("copies")).select(
        F.col("doc_id.id").alias("stay_id"), F.col("doc_id.key").alias("stay_key"), "copies"
    )
    same = lambda other: F.col("id").eqNullSafe(F.col(other + "_id")) & (F.col("key") == F.col(other + "_key"))
    stay = stay.join(copies.toDF("c_id", "c_key", "copies"), F.col("stay_key").eqNullSafe(F.col("c_key"))
                     & F.col("stay_id").eqNullSafe(F.col("c_id"))).select("stay_id", "stay_key", "copies")
    found = keyed.join(checkpoint(stay), same("stay"))
    once = found.filter("copies = 1").select("row")
    number = F.row_number().over(W.partitionBy("id", "key").orderBy(F.lit(1)))
    again = found.filter("copies > 1").withColumn("number", number).filter("number = 1").select("row")
    return once.union(again).select("row.*")
