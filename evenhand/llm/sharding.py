"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Rows of equal text form one indivisible group. Every group starts as a partial partition with
all its bytes in one subset; the two partial partitions with the largest spread (largest less
smallest subset) are combined, oppositely ordered, until one is left.

Differencing is done in hash buckets of a few thousand groups, in tasks. What a bucket yields
is a partial partition itself (one sum per shard), so buckets are combined in the same way,
level by level; only a last level of at most BUCKET_UNITS partial partitions meets in the
driver (that many times `shards` integers).
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.common import checkpoint, lookup, text_key

BUCKET_UNITS = 4_000
ROW_BYTES = 16
ORDER = "__input_order"


def difference(sums: np.ndarray) -> np.ndarray:
    """labels[i, j]: final subset of subset j of partial partition i, given its sums[i, j]."""
    n, k = sums.shape
    if not n:
        return np.zeros((0, k), np.int64)
    own = np.argsort(-sums, axis=1, kind="stable")
    nodes = list(np.take_along_axis(sums, own, axis=1))
    heap = [(-(int(row[0]) - int(row[-1])), i) for i, row in enumerate(nodes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = nodes[a] + nodes[b][::-1]
        order = np.argsort(-both, kind="stable")
        merges.append((a, b, order))
        nodes[a] = nodes[b] = None
        both = both[order]
        heapq.heappush(heap, (-(int(both[0]) - int(both[-1])), len(nodes)))
        nodes.append(both)
    labels = [None] * len(nodes)
    labels[-1] = np.arange(k)
    for node in range(len(nodes) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        before = np.empty(k, np.int64)
        before[order] = labels[node]
        labels[a], labels[b] = before, before[::-1]
        labels[node] = None
    found = np.empty((n, k), np.int64)
    np.put_along_axis(found, own, np.array(labels[:n]), axis=1)
    return found


def _combine(units: DataFrame, shards: int) -> DataFrame:
    """(unit, labels) of partial partitions (unit, sums)."""
    n = units.count()
    if n <= BUCKET_UNITS:
        rows = units.orderBy("unit").collect()
        labels = difference(np.array([r["sums"] for r in rows], np.int64).reshape(n, shards))
        found = [(r["unit"], [int(x) for x in own]) for r, own in zip(rows, labels, strict=True)]
        # at most BUCKET_UNITS x shards integers
        return F.broadcast(units.sparkSession.createDataFrame(found, "unit long, labels array<int>"))

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        labels = difference(np.array(pdf["sums"].tolist(), np.int64))
        return pd.DataFrame({"unit": pdf["unit"], "above": pdf["above"], "labels": list(labels)})

    above = F.pmod(F.xxhash64("unit"), F.lit(-(-n // BUCKET_UNITS)))
    placed = checkpoint(
        units.withColumn("above", above)
        .groupBy("above")
        .applyInPandas(level, "unit long, above long, labels array<int>")
    )
    sums = (
        placed.join(units, "unit")
        .select("above", F.explode(F.arrays_zip("labels", "sums")).alias("x"))
        .groupBy("above", F.col("x.labels").alias("slot"))
        .agg(F.sum("x.sums").alias("bytes"))
    )
    upper = _combine(_vectors(sums, "above", shards), shards)
    return placed.join(upper.toDF("above", "upper"), "above").select(
        "unit", F.transform("labels", lambda x: F.get("upper", x)).alias("labels")
    )


def _vectors(sums: DataFrame, unit: str, shards: int) -> DataFrame:
    """(unit, sums array) of rows (unit, slot, bytes); a unit has at most `shards` rows."""
    by_slot = F.map_from_entries(F.collect_list(F.struct("slot", "bytes")))
    whole = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.coalesce(F.element_at(F.col("by_slot"), s), F.lit(0).cast("long")),
    )
    return checkpoint(
        sums.groupBy(F.col(unit).alias("unit"))
        .agg(by_slot.alias("by_slot"))
        .select("unit", whole.alias("sums"))
    )


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """`groups` (group, bytes, ...) with a column `shard`."""

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=False)
        sums = np.zeros((len(pdf), shards), np.int64)
        sums[:, 0] = pdf["bytes"]
        return pdf[["group", "bucket"]].assign(slot=difference(sums)[:, 0])

    # Equal sizes are dealt by the group's hash, so all buckets see the same mixture.
    buckets = -(-max(groups.count(), 1) // BUCKET_UNITS)
    placed = checkpoint(
        groups.select("group", "bytes", F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInPandas(level, "group string, bucket long, slot int")
        .join(groups, "group")
    )
    sums = placed.groupBy("bucket", "slot").agg(F.sum("bytes").alias("bytes"))
    labels = _combine(_vectors(sums, "bucket", shards), shards)
    return placed.join(labels, placed["bucket"] == labels["unit"]).select(
        *groups.columns, F.get("labels", F.col("slot")).alias("shard")
    )


def input_order(docs: DataFrame) -> DataFrame:
    """`docs` with a column ORDER by which rows come as they were written: of Parquet files the place in
    the file, files by name, otherwise the place in the partitions."""
    try:
        path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        return docs.withColumn(ORDER, F.struct(F.length(path).alias("n"), path.alias("path"), row.alias("row")))
    except AnalysisException:  # no scan of Parquet files
        return docs.withColumn(ORDER, F.monotonically_increasing_id())


def shard(
    docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text", order: str | None = None
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (gapless in its shard).

    With the name of an `order` column, slots inside a shard follow it (rows are dealt by ranges of
    it, without their texts); ties, and rows without it, are in no particular order.

    A null text has no bytes and forms a group with other null texts; an empty text is another
    group. Rows with a null or repeated id are rows like others. A group larger than the mean
    shard stays whole (it is indivisible) and gets a shard without other large groups. An
    empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select(
        F.col(id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        text_key(F.col(text)).alias("group"),
        *([F.col(order).alias("order")] if order else []),
    )
    rows = checkpoint(rows)
    groups = checkpoint(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    placed = checkpoint(assign_groups(groups, shards).select("group", "n", "shard"))
    found = lookup(rows, placed, "group", "n", ["doc_id", "text_crc32"])
    found = checkpoint(found.repartitionByRange("order") if order else found)
    # The partitions of a checkpoint are fixed: a row's partition is a bounded part of its shard.
    found = found.withColumn("part", F.spark_partition_id())
    ahead = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        found.groupBy("shard", "part")
        .agg(F.count("*").alias("rows"))
        .withColumn("offset", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
        .select("shard", "part", "offset")
    )
    inside = W.partitionBy("shard", "part").orderBy(*(["order"] if order else []), "doc_id", "text_crc32", "size")
    inside = F.row_number().over(inside)
    return found.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + inside - 1).cast("long").alias("slot")
    )
