"""Runs registered queries beside their SQL twins: ``python -m tests.oracle sf0.01 [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

from tablewright.plans import ORACLES, QUERIES

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _table(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, name: str, folder: str) -> str | None:
    """None where both give the same rows, else what differs."""
    frame = QUERIES[name](spark, folder)
    ours = _table(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        return None if ours[1] else "no rows"
    result = con.execute(ORACLES[name])
    theirs = _table([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows against {len(theirs[1])}: {ours[1][:4]} / {theirs[1][:4]}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b or [isinstance(v, float) for v in a] != [isinstance(v, float) for v in b]:
            return f"{a} against {b}"
    return None


if __name__ == "__main__":
    from tablewright.session import local_session

    spark = local_session(8)
    folder = f"{TESTDATA}/{sys.argv[1]}"
    con = connect(folder)
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as error:  # report every query, then fail
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    sys.exit(failed > 0)
