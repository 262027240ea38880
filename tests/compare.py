"""Runs queries and their SQL side by side: python -m tests.compare FOLDER [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())


def difference(spark, folder: str, query, sql: str) -> str:
    """Empty if the rows agree."""
    df = query(spark, folder)
    columns, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    their_columns, theirs = sql_rows(folder, sql)
    if columns != their_columns:
        return f"columns {columns} and {their_columns}"
    if ours != theirs:
        a, b = set(map(repr, ours)), set(map(repr, theirs))
        return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(a - b)[:3]}, only theirs {sorted(b - a)[:3]}"
    return "" if ours else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as e
    from spliceframe.session import local_session

    session = local_session()
    session.sparkContext.setLogLevel("OFF")
    queries, sqls = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            if name in sqls:
                said = difference(session, sys.argv[1], queries[name], sqls[name]) or "ok"
            else:
                said = f"{queries[name](session, sys.argv[1]).count()} rows, no SQL"
        except Exception as x:
            said = f"FAILED {type(x).__name__}: {str(x)[:600]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
