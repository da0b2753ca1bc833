"""Removal of repeated passages by blockwise grouping of suffixes with difference-cover ranks.

A byte goes if a string of LENGTH bytes that covers it starts at another place of the corpus, in
another text or in the same one. All whole texts are searched.

1. Selection. Every suffix is put into a bucket by the least hash among the grams of GRAM bytes
   in its first LENGTH bytes (the leftmost of equal ones). Equal strings of LENGTH bytes have the
   same least gram at the same place, so they meet in one bucket, aligned at the gram. Buckets
   with one gram occurrence hold no repeat and are left out; tasks fold repeated hashes before
   the shuffle.
2. Blockwise grouping. A task takes its buckets block by block. In a block the suffixes that
   start equally far before their gram are grouped by their first LENGTH bytes: by a few bytes at both
   ends and by ranks that are computed before for a sample of the columns, a difference cover of
   period 16. A sample rank stands for 128 bytes, so two of them and two short ends decide LENGTH
   bytes. Ranks number equal strings, they are not in lexicographic order, and rows are sorted by a
   hash with neighbours compared byte by byte: removal asks only which suffixes are equal, and all that
   meet start at the same column, so the full order of the suffixes is not built. Memory is bounded
   by the block, and by the longest bucket part.
3. Buckets of more than PART_ROWS occurrences are cut into parts. What is not settled inside a part
   is compared over parts by a 128-bit digest, combined before its shuffle.
4. The runs found are cut out of the texts that have any; other texts are never moved whole again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import checkpoint, lookup

LENGTH = 200
GRAM = 60
SPAN = LENGTH - GRAM  # a suffix's gram starts 0 to SPAN bytes after it
RANKED = 128
PERIOD = 16
COVER = (0, 1, 2, 5, 8)
CHUNK = 1 << 18
PART_ROWS = 8_000
BLOCK_ROWS = 8_000
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE_BITS = 20


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_UP = _powers(_BASE, CHUNK + 2 * LENGTH)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 2 * LENGTH)


def selections(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, gram place, first suffix, last suffix) of each run of suffixes with one gram."""
    out = [[], [], [], []]
    for start in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        part = np.frombuffer(data, np.uint8, min(len(data) - start, CHUNK + LENGTH - 1), start)
        n = len(part) - GRAM + 1
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(part * _DOWN[: len(part)])]
            hashes = _mixed((sums[GRAM:] - sums[:-GRAM]) * _UP[:n])
        packed = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN + 1:
            packed = np.minimum(packed[:-width], packed[width:])
            width *= 2
        rest = SPAN + 1 - width
        if rest:
            packed = np.minimum(packed[:-rest], packed[rest:])
        gram = (packed & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        last = np.r_[first[1:], len(gram)] - 1
        for values, new in zip(out, (hashes[gram[first]].view(np.int64), gram[first] + start, first + start, last + start), strict=True):
            values.append(new)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _bytes(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


# ------------------------------------------------------------------ 1. selection


def _offers(texts: DataFrame) -> DataFrame:
    """(hash, key, sure, times): per task each hash once; where a task has a hash again, its texts
    are sure (with their number of places) and one row without a key stands for the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers, keys = [], [], []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                found = selections(_bytes(text))[0]
                if len(found):
                    hashes.append(found)
                    numbers.append(np.full(len(found), len(keys), np.int32))
                    keys.append(key.as_py())
        if not keys:
            return
        hashes, numbers = np.concatenate(hashes), np.concatenate(numbers)
        order = np.lexsort((numbers, hashes))
        hashes, numbers = hashes[order], numbers[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        sizes = np.diff(np.r_[np.flatnonzero(new), len(new)])
        again = np.repeat(sizes > 1, sizes)
        own = new | np.r_[True, numbers[1:] != numbers[:-1]]
        places = np.zeros(len(own), np.int64)
        places[own] = np.diff(np.r_[np.flatnonzero(own), len(own)])
        keys = pa.array(keys, pa.binary())
        named = lambda some: keys.take(pa.array(numbers[some]))
        for some, sure in ((~again, False), (again & own, True)):
            yield from rows_of(hashes[some], named(some), sure, places[some])
        some = again & new
        yield from rows_of(hashes[some], pa.nulls(int(some.sum()), pa.binary()), False, places[some])

    def rows_of(hashes: np.ndarray, keys: pa.Array, sure: bool, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(hashes), keys, pa.array(np.full(len(hashes), sure)), pa.array(times)]
        rows = pa.RecordBatch.from_arrays(columns, ["hash", "key", "sure", "times"])
        for start in range(0, rows.num_rows, 1 << 16):
            yield rows.slice(start, 1 << 16)

    return texts.mapInArrow(run, "hash long, key binary, sure boolean, times long")


def _repeated(offers: DataFrame) -> DataFrame:
    """(key, hash, times): grams that occur again, with their places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            sure = batch.filter(batch.column(2))
            if sure.num_rows:
                yield sure.select(["key", "hash", "times"])
            rows = pa.Table.from_batches([batch.filter(pc.invert(batch.column(2)))])
            held = rows if held is None else pa.concat_tables([held, rows])
            hashes = held.column(0).to_numpy()
            if not len(hashes):
                continue
            whole = int(np.searchsorted(hashes, hashes[-1], "left"))
            yield from complete(held.slice(0, whole))
            held = held.slice(whole).combine_chunks()
        if held is not None:
            yield from complete(held)

    def complete(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes = rows.column(0).to_numpy()
        if not len(hashes):
            return
        same = hashes[1:] == hashes[:-1]
        unsure_key = pc.is_null(rows.column(1)).to_numpy()
        starts = np.flatnonzero(np.r_[True, ~same])
        sizes = np.diff(np.r_[starts, len(hashes)])
        stand_in = np.add.reduceat(unsure_key.astype(np.int64), starts) > 0
        keep = np.repeat((sizes > 1) | stand_in, sizes) & ~unsure_key
        yield from rows.filter(pa.array(keep)).select(["key", "hash", "times"]).to_batches()

    # rows that are sure need no company: they are dealt by their key
    dealt = offers.withColumn("deal", F.when(F.col("sure"), F.xxhash64("key", "hash")).otherwise(F.col("hash")))
    return (
        dealt.repartition("deal")
        .sortWithinPartitions("hash")
        .select("hash", "key", "sure", "times")
        .mapInArrow(run, "key binary, hash long, times long")
    )


# ------------------------------------------------------------------ 2. sorting


def _in_parts(repeated: DataFrame) -> DataFrame:
    """(key, grams): by text the repeated grams (hash, parts); a bucket of more than PART_ROWS
    places has so many parts, others have parts 0."""
    counts = repeated.groupBy("hash").agg(F.sum("times").alias("places"), F.count("*").alias("n"))
    large = counts.filter(F.col("places") > PART_ROWS).select(
        "hash", "n", F.ceil(F.col("places") / PART_ROWS).cast("int").alias("parts")
    )
    found = lookup(repeated, checkpoint(large), "hash", "n", ["key"])
    gram = F.struct("hash", F.coalesce("parts", F.lit(0)).alias("parts"))
    return found.groupBy("key").agg(F.collect_set(gram).alias("grams"))


def _contexts(chosen: DataFrame) -> DataFrame:
    """(hash, part, key, at, before, after, context): the bytes of all suffixes at one repeated gram.
    They start `before` to `after` bytes ahead of the gram; `at` is the place of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out = [[] for _ in range(7)]
            for key, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                key = key.as_py()
                if key in seen:
                    continue
                seen.add(key)
                data = _bytes(text)
                hashes, grams, first, last = selections(data)
                names, parts = (wanted.values.field(i).to_numpy() for i in range(2))
                some = np.isin(hashes, names)
                cut = dict(zip(names[parts > 0].tolist(), parts[parts > 0].tolist(), strict=True))
                for h, g, a, b in zip(hashes[some].tolist(), grams[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                    part = zlib.crc32(b"%d" % a, zlib.crc32(key)) % cut[h] if h in cut else -1
                    for values, new in zip(out, (h, part, key, a, g - a, g - b, data[a : b + LENGTH]), strict=True):
                        values.append(new)
                if len(out[0]) >= BLOCK_ROWS:
                    yield rows_of(out)
                    out = [[] for _ in range(7)]
            if out[0]:
                yield rows_of(out)

    def rows_of(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        names = ["hash", "part", "key", "at", "before", "after", "context"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    return chosen.select("key", "text", "grams").mapInArrow(
        run, "hash long, part int, key binary, at long, before int, after int, context binary"
    )


_SAMPLE = np.array([c for c in range(SPAN + LENGTH + PERIOD) if c % PERIOD in COVER])


def _ranks(matrix: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks, equal for equal strings only, of the RANKED bytes at each sample column."""
    out = {}
    for column in _SAMPLE:
        if column + RANKED > matrix.shape[1]:
            break
        words = np.ascontiguousarray(matrix[:, column : column + RANKED]).view("<u8")
        out[int(column)] = _dense(words)
    return out


def _dense(words: np.ndarray) -> np.ndarray:
    """Rank of each row of integers; rows are sorted by a hash, neighbours compared whole."""
    with np.errstate(over="ignore"):
        code = np.zeros(len(words), np.uint64)
        for i in range(words.shape[1]):
            code = (code ^ words[:, i]) * np.uint64(_BASE)
            code ^= code >> np.uint64(29)
    order = np.argsort(code, kind="stable")
    same_code = code[order][1:] == code[order][:-1]
    same = same_code & (words[order][1:] == words[order][:-1]).all(axis=1)
    if (same_code & ~same).any():  # a collision: sort by the words themselves
        order = np.lexsort(words.T[::-1])
        same = (words[order][1:] == words[order][:-1]).all(axis=1)
    rank = np.empty(len(words), np.uint64)
    rank[order] = np.cumsum(np.r_[0, ~same]).astype(np.uint64)
    return rank


def repeated_suffixes(bucket: np.ndarray, before: np.ndarray, after: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """flags[i, d]: the suffix d bytes ahead of row i's gram has its first LENGTH bytes in common
    with another row of its bucket."""
    rows = len(contexts)
    matrix = np.zeros((rows, SPAN + LENGTH + PERIOD + 8), np.uint8)
    for i, context in enumerate(contexts):
        start = SPAN - before[i]
        matrix[i, start : start + len(context)] = np.frombuffer(context, np.uint8)
    ranks = _ranks(matrix)
    sample = np.array(sorted(ranks))
    flags = np.zeros((rows, SPAN + 1), bool)
    for ahead in range(SPAN + 1):
        own = np.flatnonzero((before >= ahead) & (after <= ahead))
        if len(own) < 2:
            continue
        column = SPAN - ahead
        head = int(sample[np.searchsorted(sample, column)])
        tail = int(sample[np.searchsorted(sample, column + LENGTH - RANKED, "right") - 1])
        ends = np.zeros((len(own), 2 * PERIOD), np.uint8)
        ends[:, : head - column] = matrix[own, column:head]
        rest = column + LENGTH - (tail + RANKED)
        ends[:, PERIOD : PERIOD + rest] = matrix[own, tail + RANKED : column + LENGTH]
        keys = np.column_stack([bucket[own].view(np.uint64), ranks[head][own], ranks[tail][own], ends.view("<u8")])
        rank = _dense(np.ascontiguousarray(keys))
        flags[own, ahead] = np.bincount(rank.astype(np.int64))[rank.astype(np.int64)] > 1
    return flags


def _sorted_buckets(contexts: DataFrame) -> DataFrame:
    """(key, start, stop, digest): found suffix starts [start, stop), without a digest; with one
    for single suffixes of large buckets that need other parts of the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                rows = pa.Table.from_batches(held).combine_chunks()
                hashes, parts = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                other = np.flatnonzero((hashes != hashes[-1]) | (parts != parts[-1]))
                whole = int(other[-1]) + 1 if len(other) else 0
                for start in cuts(hashes[:whole], parts[:whole]):
                    yield from sort_block(rows.slice(*start))
                rest = rows.slice(whole).combine_chunks()
                held, n = rest.to_batches(), 0  # the last bucket may go on
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            for start in cuts(rows.column(0).to_numpy(), rows.column(1).to_numpy()):
                yield from sort_block(rows.slice(*start))

    def cuts(hashes, parts) -> Iterator[tuple[int, int]]:
        """Blocks of whole buckets: (start, rows)."""
        if not len(hashes):
            return
        ends = np.flatnonzero(np.r_[(hashes[1:] != hashes[:-1]) | (parts[1:] != parts[:-1]), True]) + 1
        start = 0
        for end, following in zip(ends, np.r_[ends[1:], 1 << 60], strict=True):
            if following - start > BLOCK_ROWS or end == len(hashes):
                yield start, int(end - start)
                start = int(end)

    def sort_block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes, parts = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        if len(hashes) < 2 and parts[0] < 0:
            return
        before, after = rows.column(4).to_numpy(), rows.column(5).to_numpy()
        contexts = rows.column(6).to_pylist()
        flags = repeated_suffixes(np.ascontiguousarray(hashes), before, after, contexts)
        keys, at = rows.column(2), rows.column(3).to_numpy()
        # runs of suffix starts; in by_start they ascend as the distance to the gram falls
        by_start = np.zeros((len(at), SPAN + 3), np.int8)
        by_start[:, 1:-1] = flags[:, ::-1]
        step = np.diff(by_start, axis=1)
        row, first = np.nonzero(step == 1)
        _, stop = np.nonzero(step == -1)
        origin = at + before - SPAN
        yield found(keys.take(pa.array(row)), origin[row] + first, origin[row] + stop, None)
        for i in np.flatnonzero(parts >= 0).tolist():
            ahead = np.arange(after[i], before[i] + 1)
            digests, starts = [], []
            for d in ahead.tolist():
                place = int(before[i]) - d
                digest = hashlib.blake2b(contexts[i][place : place + LENGTH], digest_size=16).digest()
                if flags[i, d] and digest in settled:
                    continue
                if flags[i, d]:
                    settled.add(digest)
                digests.append(digest)
                starts.append(int(at[i]) + place)
            start = np.array(starts, np.int64)
            yield found(pa.array([keys[i].as_py()] * len(starts), pa.binary()), start, start + 1, digests)
        settled.clear()

    def found(keys, start: np.ndarray, stop: np.ndarray, digests: list | None) -> pa.RecordBatch:
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        digests = pa.array(digests if digests is not None else [None] * len(start), pa.binary())
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(start), pa.array(stop), digests], ["key", "start", "stop", "digest"]
        )

    settled: set[bytes] = set()  # digests of found suffixes that this block has offered to other parts
    return (
        contexts.repartition("hash", "part")
        .sortWithinPartitions("hash", "part")
        .mapInArrow(run, "key binary, start long, stop long, digest binary")
    )


# ------------------------------------------------------------------ 4. removal


def removed_runs(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings that start in the half-open intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        end = b - 1 + LENGTH
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((a, end))
    return out


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per row of `docs`.

    `kept` (left out without `keep_bytes`) are the bytes that stay, null where none goes. A null text counts as empty; a text of
    under LENGTH bytes loses none. Rows of equal text are copies of each other whatever their
    ids, which may be null or repeated. An empty table gives no rows.
    """
    source = docs.select(
        F.col(id).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data")
    )
    rows = checkpoint(
        source.select(
            "doc_id",
            F.unhex(F.md5("data")).alias("key"),
            F.octet_length("data").cast("long").alias("n_bytes"),
            F.sha2("data", 256).alias("sha"),
        )
    )
    copies = rows.groupBy("key").agg(F.count("*").alias("n"))
    texts = docs.select(
        F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))).alias("key"),
        F.col(text).alias("text"),
        F.col(id).alias("doc_id"),
    )
    repeated = checkpoint(_repeated(_offers(texts.select("key", "text"))))
    wanted = checkpoint(_in_parts(repeated).join(copies, "key"))
    chosen = checkpoint(
        lookup(texts, wanted.withColumn("copies", F.col("n")), "key", "n", ["doc_id"], "inner").drop("doc_id")
    )
    runs = checkpoint(_sorted_buckets(_contexts(chosen)))
    digests = runs.filter("digest is not null")
    met = digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    across = lookup(digests, checkpoint(met), "digest", "n", ["key", "start"], "inner")
    settled = runs.filter("digest is null").select("key", "start", "stop").union(across.select("key", "start", "stop"))
    starts = settled.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for text, copies, starts in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = _bytes(text)
                pairs = [(x["start"], x["stop"]) for x in starts or []]
                if copies > 1:
                    pairs.append((0, len(data) - LENGTH + 1))
                spans = removed_runs(pairs)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                new = (len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)
                for values, value in zip(out, new, strict=True):
                    values.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]],
                ["key", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    once = chosen.groupBy("key").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
    once = once.join(starts, "key", "left").select("key", "text", "copies", "starts")
    done = once.mapInArrow(cut, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done = done.filter("n_spans > 0").join(copies, "key")
    joined = lookup(rows, checkpoint(done if keep_bytes else done.drop("kept")), "key", "n", ["doc_id"])
    return joined.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *(["kept"] if keep_bytes else []),
    )
