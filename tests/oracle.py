"""Runs registered queries beside their SQL and compares rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def compare(spark, c, query, sql, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=repr)
    cur = c.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    want = sorted((tuple(_cell(float(r[cols.index(n)]) if type(r[cols.index(n)]).__name__ == "Decimal" else r[cols.index(n)]) for n in names) for r in cur.fetchall()), key=repr)
    if got == want:
        return None
    diff = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
    return f"{len(got)} and {len(want)} rows; {diff}"
