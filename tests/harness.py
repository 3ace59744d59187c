"""Compare a registered query with its SQL in DuckDB on the same Parquet files."""

from __future__ import annotations

import glob
import os

import duckdb

from tracewright.catalog import base


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(rows):
    def cell(x):
        if isinstance(x, list):
            return str([round(v, 5) if isinstance(v, float) else v for v in x])
        if isinstance(x, float):
            return f"{round(x, 5) + 0.0:.5f}"
        return str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


def compare(name: str, spark, con, sf_dir: str, allow_empty: bool = False) -> str | None:
    """None when equal, else a short description of the difference."""
    df = base.run(name, spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    want = con.execute(base.oracle(name)).fetchall()
    if not want and not allow_empty:
        return "oracle is empty"
    a, b = _rows(got), _rows(want)
    if a == b:
        return None
    sa, sb = set(a), set(b)
    diff = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
    cols = [c for c, _ in base.REGISTRY[name].cols]
    detail = ""
    if diff[0] and diff[1] and len(cols) > 6:
        g = diff[0][0]
        for w in b:
            if w[0] == g[0] and (len(a) <= 2000 or w[1] == g[1]) and (cols[1] != "t" or w[1] == g[1]):
                detail = str([(c, x, y) for c, x, y in zip(cols, g, w) if x != y])
                break
    return f"rows {len(a)} vs {len(b)}; {detail or diff}"
