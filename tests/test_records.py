"""Multi-line CSV read by many tasks."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenhand.sources import comments as src
from evenhand.sources import records

SCHEMA = pa.schema([("value", pa.string()), ("file", pa.string()), ("start", pa.int64())])


def split_lines(files, size, batch):
    """Lines of every file as a scan gives them: a line belongs to the split that it begins in."""
    rows = []
    for name, text in files.items():
        at = 0
        for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
            rows.append((line, name, at // size * size))
            at += len(line.encode()) + 1
    for i in range(0, len(rows), batch):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + batch]), SCHEMA)], schema=SCHEMA)


def put_together(files, size, batch):
    counts = [tuple(r.values()) for b in records._count(split_lines(files, size, batch)) for r in b.to_pylist()]
    splits = records.layout(counts)
    whole, pieces = [], {}
    for b in records._assemble(split_lines(files, size, batch), splits):
        for r in b.to_pylist():
            key = (r["doc_no"], r["file"], r["record_no"])
            if r["piece"] is None:
                whole.append((*key, r["text"]))
            else:
                pieces.setdefault(key, []).append((r["piece"], r["text"]))
    return sorted(whole + [(*k, "\n".join(t for _, t in sorted(v))) for k, v in pieces.items()])


def random_file(draw, n):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n", quoting=draw.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    rows = [["id", "text"]]
    for i in range(n):
        text = "".join(draw.choice(['"', "\n", "\n\n", ",", "a", "bc ", "é", "\r\n"]) for _ in range(draw.choice([0, 3, 12, 40])))
        rows.append([str(i), text])
    for row in rows:
        writer.writerow(row)
        if draw.random() < 0.1:
            out.write("\n")  # a blank line
    text = out.getvalue()
    return rows, text if draw.random() < 0.7 else text.rstrip("\n")


@pytest.mark.parametrize("seed", range(60))
def test_records_of_any_splits(seed):
    draw = random.Random(seed)
    files, expected, earlier = {}, [], 0
    for name in ["a", "b", "c"][: draw.randrange(1, 4)]:
        rows, files[name] = random_file(draw, draw.choice([0, 1, 5, 40]))
        expected += [(earlier + i - 1, name, i, row) for i, row in enumerate(rows)]
        earlier += len(rows) - 1
    got = put_together(files, draw.choice([1, 7, 50, 400, 10_000]), draw.choice([1, 3, 1000]))
    parsed = [(d, f, n, next(csv.reader(io.StringIO(text, newline="")))) for d, f, n, text in got]
    assert sorted(parsed) == sorted(expected)


def test_changed_splits_fail():
    with pytest.raises(RuntimeError, match="changed"):
        list(records._assemble(split_lines({"a": "x\n"}, 10, 5), {}))


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)


@pytest.fixture()
def large_csv(tmp_path):
    """One file with many newlines and quotes in fields, empty and long fields, a long record."""
    draw = random.Random(9)
    words = ["plain", 'quo"ted', "new\nline", "com,ma", "two\n\nlines", "é東", "", " lead", "tail ", "\tt"]
    rows = [["id", "comment_text", "target", "odd name"]]
    for i in range(3000):
        text = " ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 5, 30])))
        rows.append([str(i), text, draw.choice(["0.5", "", "junk"]), text[:3]])
    rows.insert(1500, ["long", "x\n" * 20_000, "1", "y"])
    write(tmp_path / "large.csv", rows)
    return str(tmp_path / "large.csv"), rows


def test_many_tasks_read_what_one_task_reads(spark, small_splits, large_csv):
    path, rows = large_csv
    many, one = src.csv_rows(spark, path), src.csv_rows(spark, path, whole_files=True)
    assert many.columns == one.columns == rows[0]
    counts = records.lines(spark, path).groupBy(F.spark_partition_id()).count()
    assert counts.count() > 20  # tasks for the one file
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect()))
    assert many.exceptAll(one).count() == 0 and many.count() == len(rows) - 1


def test_projection_parses_only_what_is_asked_for(spark, small_splits, large_csv):
    path, rows = large_csv
    some = src.csv_rows(spark, path, ["target", "id"])
    assert some.columns == ["target", "id"]
    assert sorted((r.id, r.target) for r in some.collect()) == sorted((r[0], r[2] or None) for r in rows[1:])


def test_record_numbers_are_file_order(spark, small_splits, large_csv, tmp_path):
    path, rows = large_csv
    folder = tmp_path / "two"
    folder.mkdir()
    write(folder / "a.csv", rows[:1] + rows[2000:])
    write(folder / "b.csv", rows[:2000])
    write(folder / "c.csv", rows[:1])
    for where, expected in ((path, rows[1:]), (str(folder), rows[2000:] + rows[1:2000])):
        got = src.indexed_comments(spark, where).orderBy("doc_index").collect()
        assert [r.doc_index for r in got] == list(range(len(expected)))
        assert [(r.comment_text, r.target) for r in got] == [(r[1], r[2]) for r in expected]
    one_task = src.indexed_comments(spark, path).coalesce(1).collect()
    assert sorted(one_task) == sorted(src.indexed_comments(spark, path).collect())


def test_only_pieces_at_borders_are_shuffled(spark, small_splits, large_csv):
    path, rows = large_csv
    counts = records.lines(spark, path).mapInArrow(records._count, records.COUNTS).collect()
    splits = records.layout(tuple(r) for r in counts)
    found = records.lines(spark, path).mapInArrow(lambda b: records._assemble(b, splits), records.PIECES)
    assert found.filter("piece is not null").count() <= 2 * len(splits)
    assert found.filter("piece is null").count() > len(rows) / 2


def test_carriage_returns_and_blank_lines(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes(b'\xef\xbb\xbfid,text\r\n1,"a\r\nb"\r\n\r\n2,c\r\n3,""\r\n4,\r\n')
    many = sorted(map(tuple, src.csv_rows(spark, str(path)).collect()))
    assert many == sorted(map(tuple, src.csv_rows(spark, str(path), whole_files=True).collect()))
    assert [r[0] for r in many] == ["1", "2", "3", "4"]


def test_ragged_records(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("id,text\n1\n2,b,extra\n,\n \n")
    many = sorted(map(repr, src.csv_rows(spark, str(path)).collect()))
    assert many == sorted(map(repr, src.csv_rows(spark, str(path), whole_files=True).collect()))


def test_header_only(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,comment_text\n")
    assert src.csv_rows(spark, str(tmp_path / "h.csv")).collect() == []
    assert src.indexed_comments(spark, str(tmp_path / "h.csv")).collect() == []
