"""Compare a Spark result with DuckDB's, as multisets of rows with columns sorted by name."""

import math
import os
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in values)


def compare(df, con, sql: str):
    """None, or what differs."""
    cur = con.execute(sql)
    want_columns, want = rows([c[0] for c in cur.description], cur.fetchall())
    got_columns, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if want_columns != got_columns:
        return f"columns {got_columns} and {want_columns}"
    if want != got:
        a, b = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"{len(got)} and {len(want)} rows; only here {a}; only there {b}"
    return None
