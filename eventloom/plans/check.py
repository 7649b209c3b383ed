"""Compare registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) or "" for i in order) for r in rows), [names[i] for i in order]


def oracle_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir, name, run, sql):
    """(ok, message, seconds)"""
    started = time.time()
    df = run(spark, sf_dir)
    got, got_names = _rows(df.columns, df.collect())
    spent = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows (no oracle)", spent
    want, want_names = _rows(*oracle_rows(con, sql))
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}", spent
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return False, f"{len(got)} vs {len(want)} rows; extra {extra}; missing {missing}", spent
    return True, f"{len(got)} rows", spent
