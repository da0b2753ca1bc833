"""Benchmark passages in documents by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z) and reduced to words of digits, a-z and characters beyond ASCII. The
patterns are the windows of `window` consecutive words of every benchmark item; an item of
fewer words is one pattern. Both sides are written as " word word ... ", so a byte string
match is a match of whole words.

Search (`Matcher`): patterns are cut to the length of the shortest of their class. A shift table
says for each hashed block of text how far the search may jump; where it can't jump, the block's
bucket gives the patterns that end there, their first block is compared, then the whole string.
Blocks have 8 bytes: Wu and Manber's rule, log_c(2 x length x patterns), for syllables that
repeat as often as in prose. Many cursors walk a batch in step, as numpy arrays.

The benchmark goes to the tasks in blocks of bounded bytes (BLOCK_BYTES), each a narrow pass over
the documents; the documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Benchmark text in one broadcast.
BLOCK_BYTES = 4 << 20
PIECE_WORDS = 50_000
BATCH_BYTES = 1 << 20
SEGMENT = 256
TABLE_BITS = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEEP = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def _blocks_of(data: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes that start at each place, as one integer each."""
    if size == 8:
        return np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    out = np.zeros(max(len(data) - size + 1, 0), np.uint64)
    for i in range(size):
        out |= data[i : i + len(out)].astype(np.uint64) << np.uint64(8 * i)
    return out


def _slot(blocks: np.ndarray) -> np.ndarray:
    return ((blocks * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class _Table:
    """Shift table and suffix buckets of patterns of similar length."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.least = min(map(len, patterns))
        self.block = min(8, self.least)
        heads = np.frombuffer(b"".join(p[: self.least] for p in patterns), np.uint8).reshape(-1, self.least)
        far = min(self.least - self.block + 1, 255)
        self.shift = np.full(1 << TABLE_BITS, far, np.uint8)
        for end in range(self.least - self.block + 1):  # later blocks allow smaller jumps
            at = _blocks_of_rows(heads, end, self.block)
            np.minimum.at(self.shift, _slot(at), np.uint8(min(self.least - self.block - end, 255)))
        suffix = _blocks_of_rows(heads, self.least - self.block, self.block)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.prefix = suffix[order], _blocks_of_rows(heads, 0, self.block)[order]
        self.patterns = [patterns[i] for i in order]
        self.numbers = np.array(numbers)[order]

    def find(self, raw: bytes, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern number) of every occurrence."""
        blocks = _blocks_of(data, self.block)
        first = self.least - self.block  # where the last block of the first window starts
        at = np.arange(first, len(blocks), SEGMENT)
        stop = np.minimum(at + SEGMENT, len(blocks))
        ends = []
        while len(at):
            jump = self.shift[_slot(blocks[at])]
            ends.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        low = np.searchsorted(self.suffix, blocks[ends], "left")
        many = np.searchsorted(self.suffix, blocks[ends], "right") - low
        start = np.repeat(ends - first, many)
        which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        same = blocks[start] == self.prefix[which]
        start, which = start[same], which[same]
        sure = [raw.startswith(self.patterns[w], s) for s, w in zip(start.tolist(), which.tolist(), strict=True)]
        sure = np.array(sure, bool)
        return start[sure], self.numbers[which[sure]]


def _blocks_of_rows(rows: np.ndarray, start: int, size: int) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for i in range(size):
        out |= rows[:, start + i].astype(np.uint64) << np.uint64(8 * i)
    return out


class Matcher:
    """All windows of the benchmark pieces (item name or None, words joined by spaces)."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int = WINDOW):
        owners: dict[bytes, set] = defaultdict(set)
        lengths: dict[bytes, int] = {}
        for name, text in pieces:
            words = text.split()
            for start in range(max(1, len(words) - window + 1)):
                own = words[start : start + window]
                pattern = b" " + b" ".join(own) + b" "
                owners[pattern].add(name)
                lengths[pattern] = len(own)
        self.patterns = list(owners)
        self.owners = [owners[p] for p in self.patterns]
        self.lengths = np.array([lengths[p] for p in self.patterns], np.int64)
        classes = defaultdict(list)
        for number, pattern in enumerate(self.patterns):
            classes[min(len(pattern).bit_length(), 6)].append(number)
        self.tables = [_Table([self.patterns[n] for n in own], own) for own in classes.values()]

    def search(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """Per text (as words): merged runs of hit words [from, to), and the items that occur."""
        raw = b"\x00".join(b" " + b" ".join(words) + b" " for words in texts) + b"\x00" * 8
        data = np.frombuffer(raw, np.uint8)
        starts, numbers = [], []
        for table in self.tables:
            start, number = table.find(raw, data)
            starts.append(start)
            numbers.append(number)
        found = [([], set()) for _ in texts]
        start, number = np.concatenate(starts), np.concatenate(numbers)
        if not len(start):
            return found
        cuts = np.flatnonzero(data == 0)
        spaces = np.flatnonzero(data == 32)
        text = np.searchsorted(cuts, start)
        begin = np.r_[0, cuts + 1][text]
        word = np.searchsorted(spaces, start) - np.searchsorted(spaces, begin)
        order = np.lexsort((word, text))
        for i in order.tolist():
            runs, items = found[text[i]]
            a, b = int(word[i]), int(word[i] + self.lengths[number[i]])
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
            items |= self.owners[number[i]]
        return found


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searched(matcher: Matcher, column: pa.Array) -> Iterator[tuple[int, list, set]]:
    """(words, runs, items) of each text, about BATCH_BYTES of text at a time."""
    batch, size = [], 0
    for value in column:
        words = words_of(value.as_py())
        batch.append(words)
        size += sum(map(len, words)) + len(words)
        if size >= BATCH_BYTES:
            for words, (runs, items) in zip(batch, matcher.search(batch), strict=True):
                yield len(words), runs, items
            batch, size = [], 0
    if batch:
        for words, (runs, items) in zip(batch, matcher.search(batch), strict=True):
            yield len(words), runs, items


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> list:
    """Broadcasts of at most about `block_bytes` of benchmark words each.

    Long items are cut into pieces that overlap by window - 1 words. The rows come to the
    driver one partition at a time and leave it block by block.
    """
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(WORD), 0)
    pieces = (
        benchmark.select(F.col(item).cast("string").alias("item"), words.alias("words"))
        .filter(F.size("words") > 0)
        .select(
            "item",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)), F.lit(PIECE_WORDS)),
                    lambda s: F.array_join(F.slice(F.col("words"), s, F.lit(PIECE_WORDS + window - 1)), " "),
                )
            ).alias("piece"),
        )
    )
    context = benchmark.sparkSession.sparkContext
    blocks, block, size = [], [], 0
    for row in pieces.toLocalIterator():
        piece = row["piece"].encode("utf-8", "surrogatepass")
        if block and size + len(piece) > block_bytes:
            blocks.append(context.broadcast(block))
            block, size = [], 0
        block.append((row["item"], piece))
        size += len(piece)
    if block or not blocks:
        blocks.append(context.broadcast(block))
    return blocks


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, hits, items), one row per row of `docs`.

    `hits` are the merged runs of hit words (from, to), `items` the sorted ids, as strings, of
    the items with an occurring window. A null text has no words; an item without words has no
    window; an item with a null id hits words but is not listed; repeated items count once.
    Without items nothing is hit. Other columns of either table are not looked at.
    """

    def pass_over(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block.value, window)
            for batch in batches:
                counts, hits, items = [], [], []
                before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
                found = _searched(matcher, batch.column(1)) if matcher.tables else (
                    (len(words_of(t.as_py())), [], set()) for t in batch.column(1)
                )
                for (n, runs, own), (old_runs, old_items) in zip(found, before, strict=True):
                    runs = _merged(runs + [(x["from"], x["to"]) for x in old_runs])
                    counts.append(n)
                    hits.append([{"from": a, "to": b} for a, b in runs])
                    items.append(sorted((own - {None}) | set(old_items)))
                run_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(counts, pa.int64()),
                        pa.array(hits, run_type),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["doc_id", "text", "n_words", "hits", "items"],
                )

        return run

    found = docs.select(
        F.col(id).alias("doc_id"),
        F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)").alias("hits"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    for block in benchmark_blocks(benchmark, item, item_text, window, block_bytes):
        found = found.mapInArrow(pass_over(block), schema)
    return found.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `occurrences`."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of `docs`, all columns, in which no window of the benchmark occurs."""
    place = docs.columns.index(text)
    for block in benchmark_blocks(benchmark, "item_id", "text", window, block_bytes):

        def run(batches, block=block):
            matcher = Matcher(block.value, window)
            for batch in batches:
                if matcher.tables:
                    keep = [not runs for _, runs, _ in _searched(matcher, batch.column(place))]
                    batch = batch.filter(pa.array(keep, pa.bool_()))
                yield batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def sql_twin() -> str:
    """The same result in DuckDB's SQL."""
    upper, lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
    words = f"regexp_extract_all(translate(coalesce(text, ''), {upper}, {lower}), '{WORD}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT item_id, {words} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS g, least(len(w), {WINDOW}) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM i WHERE len(w) > 0)
),
n AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, n WHERE len(w) >= n)
),
h AS (SELECT r, s, g.n, item_id FROM g JOIN p ON g.g = p.g AND g.n = p.n),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS x FROM h) GROUP BY r),
t AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM h GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
