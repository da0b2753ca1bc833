from collections import defaultdict
import zlib

import numpy as np

from pyspark.sql import functions as F

from evenhand.llm import sharding
from evenhand.llm.common import checkpoint
from tests.llm.conftest import prose


def test_difference_is_the_textbook_example():
    sums = np.zeros((5, 2), np.int64)
    sums[:, 0] = [8, 7, 6, 5, 4]
    labels = sharding.difference(sums)[:, 0]
    totals = sorted(sum(s for s, x in zip([8, 7, 6, 5, 4], labels) if x == side) for side in (0, 1))
    assert totals == [14, 16]  # differencing leaves 2 here


def test_difference_keeps_partial_partitions_apart():
    draw = np.random.default_rng(1)
    sums = draw.integers(0, 1000, (50, 7))
    labels = sharding.difference(sums)
    assert all(sorted(row) == list(range(7)) for row in labels)
    totals = np.zeros(7, np.int64)
    np.add.at(totals, labels.ravel(), sums.ravel())
    assert totals.max() - totals.min() < 100
    assert sharding.difference(np.zeros((0, 7), np.int64)).shape == (0, 7)


def check(rows, found, shards):
    assert len(found) == len(rows)
    slots, where, size = defaultdict(list), {}, defaultdict(int)
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in found) == want
    for r in found:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        assert 0 <= r.shard < shards
        if r.size > 16:
            assert where.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size


def test_shards(odd_docs, odd_rows, no_docs):
    check(odd_rows, sharding.shard(odd_docs, 5).collect(), 5)
    assert sharding.shard(no_docs, 5).count() == 0


def test_levels_give_equal_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_UNITS", 40)
    rows = [(i, "x" * (i * 37 % 501)) for i in range(4000)]
    size = check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect(), 6)
    assert max(size.values()) - min(size.values()) <= 517


def test_slots_follow_the_input_order(spark, tmp_path):
    """Rows of a checkpoint and of Parquet files of different sizes, repeats included."""
    texts = [(i, prose(i % 90, 3 + i % 40 * (1 + 9 * (i < 60)))) for i in range(400)]
    docs = spark.createDataFrame(texts + texts[:50], "doc_id long, text string")
    ordered = docs.repartitionByRange(6, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id"))
    ordered.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        for given in (checkpoint(ordered), spark.read.parquet(str(tmp_path / "t"))):
            found = sharding.shard(sharding.input_order(given), 5, order=sharding.ORDER).collect()
            assert len(found) == 450
            by_shard = {}
            for r in found:
                by_shard.setdefault(r.shard, []).append((r.slot, r.doc_id))
            where = {d: r.shard for r in found for d in [r.doc_id]}
            expected = [r.doc_id for r in ordered.collect()]
            for shard, rows in by_shard.items():
                assert [s for s, _ in sorted(rows)] == list(range(len(rows)))
                assert [d for _, d in sorted(rows)] == [d for d in expected if where[d] == shard]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
