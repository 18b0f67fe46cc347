"""Queries side by side with their SQL in DuckDB."""

from __future__ import annotations

import glob
import os
from collections import Counter

DATA = os.environ.get("HEADWATER_TESTDATA", "/root/testdata/sf0.001")


def rows_of(df) -> Counter:
    cols = sorted(df.columns)
    return Counter(tuple(_plain(v) for v in r) for r in df.select(*cols).collect())


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(v) if isinstance(v, list) else v


def duck_rows(sql: str, sf_dir: str = DATA) -> Counter:
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(f)[:-8]}\" AS SELECT * FROM '{f}'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(x[i]) for i in order) for x in r.fetchall())
