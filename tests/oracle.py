"""Runs queries beside their SQL in DuckDB and compares all rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    return x if x is None or isinstance(x, (bool, int)) else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([_plain(r[i]) for i in order] for r in found), key=repr)


def compare(frame, db, sql):
    theirs = db.sql(sql)
    ours = rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert ours[0] == sorted(theirs.columns)
    expected = rows(theirs.columns, theirs.fetchall())
    assert len(ours[1]) == len(expected[1])
    for a, b in zip(ours[1], expected[1], strict=True):
        assert a == b
