"""Runs registered queries against their SQL oracles: python tests/oracle_compare.py [sf_dir] [names]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cleaned = []
    for row in rows:
        values = []
        for i in order:
            value = row[i]
            if isinstance(value, float):
                value = None if math.isnan(value) else value + 0.0
            values.append(value)
        cleaned.append(tuple(values))
    return sorted(cleaned, key=repr)


def differences(spark, connection, name, query, sql, sf_dir) -> list[str]:
    df = query(spark, sf_dir)
    found = [tuple(row) for row in df.collect()]
    relation = connection.sql(sql)
    expected = relation.fetchall()
    if sorted(df.columns) != sorted(relation.columns):
        return [f"columns {sorted(df.columns)} != {sorted(relation.columns)}"]
    if len(found) != len(expected):
        return [f"{len(found)} rows != {len(expected)} rows"]
    ours, theirs = normal(found, df.columns), normal(expected, relation.columns)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    types = {type(v) for r in ours[:50] for v in r} ^ {type(v) for r in theirs[:50] for v in r}
    problems = [f"{len(wrong)} rows differ, first {str(wrong[0])[:600]}"] if wrong else []
    return problems + ([f"types {types}"] if types else [])


if __name__ == "__main__":
    import __spark_entry__ as contract
    from evenhand.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    connection = connect(sf_dir)
    sqls = contract.oracle_sql()
    for name, query in contract.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        if name not in sqls:
            print(f"rows  {name} {query(spark, sf_dir).count()}", flush=True)
            continue
        try:
            problems = differences(spark, connection, name, query, sqls[name], sf_dir)
        except Exception as error:  # report every query
            problems = [f"{type(error).__name__}: {str(error)[:800]}"]
        print(f"{'DIFF ' if problems else 'ok   '} {name} {time.time() - start:.1f}s", *problems, flush=True)
