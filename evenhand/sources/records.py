"""Records of CSV files whose quoted fields hold newlines, read by many tasks for each file.

Spark can cut a text file at any newline but not a CSV file, because a newline may stand inside
quotes. A doubled quote does not change whether the number of quotes so far is odd, so a line
begins a record exactly where the number of quotes before it in the file is even. Two scans use
that:

1. every task counts, for each split of a file, its quotes and how many records would begin in
   it if it began outside or inside quotes. The splits' counts are few numbers for each split, as
   many as Spark's own scan planning holds; added up along a file they tell which case it is,
   and how many records come before.
2. every task joins the lines of its splits to records. Only the pieces of a record that crosses
   a split's border are brought together by a shuffle.

The records go to Spark's own CSV parser (``from_csv``). A file in which quotes stand inside
unquoted fields is not covered by that rule; ``csv_rows`` reads such files whole on request.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = "file string, start long, odd boolean, outside long, inside long"
PIECES = "file string, record_no long, doc_no long, piece long, text string"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, start): lines with the split that they begin in, in order inside a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """(split, lines) for every run of lines of one split."""
    for batch in batches:
        files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        codes = files.indices.to_numpy()
        changes = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        borders = [0, *changes.tolist(), len(starts)]
        for a, b in zip(borders, borders[1:]):
            if a < b:
                yield (files.dictionary[int(codes[a])].as_py(), int(starts[a])), batch.column(0).slice(a, b - a)


def _inside(values: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside quotes; and whether the line after the last one does."""
    quotes = pc.count_substring(values, '"').to_numpy()
    after = (np.cumsum(quotes) + inside) % 2 == 1
    return np.concatenate([[inside], after[:-1]]), bool(after[-1])


def _blank(values: pa.Array) -> np.ndarray:
    return np.asarray(pc.is_in(values, pa.array(["", "\r"])))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: is its number of quotes odd, and how many records begin in it if it
    begins outside or inside quotes. Blank lines outside quotes are no records."""
    names = ["file", "start", "odd", "outside", "inside"]
    for split, runs in groupby(_runs(batches), key=lambda run: run[0]):
        odd, outside, inside = False, 0, 0
        for _, values in runs:
            within, odd = _inside(values, odd)
            full = ~_blank(values)
            outside += int((full & ~within).sum())
            inside += int((full & within).sum())
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*split, odd, outside, inside)], names)


@dataclass(frozen=True)
class Split:
    """What comes before a split: whether it begins inside quotes, the records that have begun in its
    file, and the records of the files before, without their headers."""

    inside: bool
    first: int
    other_files: int


def layout(counts: Iterable[tuple[str, int, bool, int, int]]) -> dict[tuple[str, int], Split]:
    """Adds the splits' counts up along each file, files in the order of their paths."""
    found, earlier = {}, 0
    for _, splits in groupby(sorted(counts), key=lambda row: row[0]):
        inside, begun = False, 0
        for file, start, odd, outside, within in splits:
            found[file, start] = Split(inside, begun, earlier)
            begun += within if inside else outside
            inside ^= odd
        earlier += max(begun - 1, 0)
    return found


def _assemble(
    batches: Iterable[pa.RecordBatch], splits: dict[tuple[str, int], Split]
) -> Iterator[pa.RecordBatch]:
    """Records that end inside their split (piece null), and for each split the lines at its begin
    and end that may belong to a record of several splits (piece = the split's start)."""
    for split, runs in groupby(_runs(batches), key=lambda run: run[0]):
        if split not in splits:
            raise RuntimeError(f"the files or their splits changed between two scans: {split}")
        at = splits[split]
        inside, begun = at.inside, at.first  # records of the file that have begun so far
        open_lines: list[str] = []  # of the record numbered begun - 1

        def rows(texts, first, piece):
            n = len(texts)
            numbers = np.arange(first, first + n)
            arrays = [
                pa.array([split[0]] * n),
                pa.array(numbers),
                pa.array(numbers - 1 + at.other_files),
                pa.array([piece] * n, pa.int64()),
                texts.cast(pa.string()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["file", "record_no", "doc_no", "piece", "text"])

        for _, values in runs:
            within, inside = _inside(values, inside)
            kept = np.flatnonzero(within | ~_blank(values))
            begins = np.flatnonzero(~within[kept])  # places among the kept lines
            values = values.take(pa.array(kept))
            if not len(begins):
                open_lines += values.to_pylist()
                continue
            open_lines += values.slice(0, begins[0]).to_pylist()
            if open_lines:
                whole = begun > at.first
                yield rows(pa.array(["\n".join(open_lines)]), begun - 1, None if whole else split[1])
            texts = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), values)
            if len(texts):
                yield rows(pc.binary_join(texts, "\n"), begun, None)
            begun += len(begins)
            open_lines = values.slice(begins[-1]).to_pylist()
        if open_lines:
            yield rows(pa.array(["\n".join(open_lines)]), begun - 1, split[1])


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record_no, doc_no, record): every record of one or more CSV files as text. ``record_no``
    counts from 0, the header, inside a file; ``doc_no`` from 0 over all files in the order of their
    paths, without headers.

    The first scan runs at once, the second when the result is used. Both must see the same files
    and splits, otherwise the job fails and has to be run again. Blank lines are no records.
    """
    counts = lines(spark, path).mapInArrow(_count, COUNTS).collect()
    sent = spark.sparkContext.broadcast(layout(tuple(row) for row in counts))
    pieces = lines(spark, path).mapInArrow(lambda batches: _assemble(batches, sent.value), PIECES)
    parts = F.sort_array(F.collect_list(F.struct("piece", "text")))
    key = ["file", "record_no", "doc_no"]
    crossing = pieces.filter("piece is not null").groupBy(*key)
    crossing = crossing.agg(F.array_join(parts["text"], "\n").alias("text"))
    found = pieces.filter("piece is null").select(*key, "text").unionByName(crossing)
    # Universal newlines, also inside fields, as readers of text files have them.
    return found.select(*key, F.regexp_replace("text", "\r(\n|$)", "$1").alias("record"))


def folder_value(file: Column, name: str) -> Column:
    """The value of a partition column from a file's path, whose folders are named column=value with
    escapes of their own inside the path's."""
    value = F.regexp_extract(file, f"/{re.escape(quote(name))}=([^/]*)/", 1)
    for _ in range(2):
        value = F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    return F.when(value != "__HIVE_DEFAULT_PARTITION__", value)
