"""Run one registered query on Spark and its SQL on DuckDB and compare names, rows and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def sort_key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def difference(spark_df, con, sql) -> str | None:
    names = sorted(spark_df.columns)
    got = sorted((tuple(norm(r[n]) for n in names) for r in spark_df.collect()), key=sort_key)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}"
    idx = [cols.index(n) for n in names]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in cur.fetchall()), key=sort_key)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; spark {got[:2]} duck {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ; columns {names}\n  spark {bad[0][0]}\n  duck  {bad[0][1]}"
    tg = [type(x).__name__ for x in got[0]] if got else []
    tw = [type(x).__name__ for x in want[0]] if want else []
    for n, a, b in zip(names, tg, tw):
        if a != b and "NoneType" not in (a, b):
            return f"type of {n}: {a} vs {b}"
    return None
