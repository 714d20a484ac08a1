"""Compare registered queries with their SQL on DuckDB.

    python -m tests.oracle [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else str(v) if not isinstance(v, float) else f"{v:+.4e}") for v in row)


def compare(got_cols, got, want_cols, want) -> str | None:
    """None when equal, else a short description of the first difference."""
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    order = sorted(got_cols)
    a = sorted([tuple(r[got_cols.index(c)] for c in order) for r in got], key=_key)
    b = sorted([tuple(r[want_cols.index(c)] for c in order) for r in want], key=_key)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:1]} / {b[:1]}"
    for x, y in zip(a, b):
        for c, p, q in zip(order, x, y):
            if p is None or q is None:
                same = p is None and q is None
            elif isinstance(p, float) or isinstance(q, float):
                same = p == q or math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6)
            else:
                same = p == q and type(p) is type(q)
            if not same:
                return f"{c}: {p!r} != {q!r} in {x} / {y}"
    return None


def exact(got_cols, got, want_cols, want) -> bool:
    order = sorted(got_cols)
    pick = lambda cols, rows: sorted(repr(tuple(r[cols.index(c)] for c in order)) for r in rows)
    return pick(got_cols, got) == pick(want_cols, want)


def strict_difference(spark, con, name, sf_dir, queries, oracles) -> str:
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(oracles[name])
    cols = [d[0] for d in cur.description]
    want = [tuple(r[cols.index(c)] for c in df.columns) for r in cur.fetchall()]
    found = []
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        found += [f"{c}: {p!r}|{q!r}" for c, p, q in zip(df.columns, a, b) if repr(p) != repr(q)]
    return "; ".join(found[:3])


def run(spark, con, name: str, sf_dir: str, queries, oracles):
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if name not in oracles:
        return seconds, len(got), "no SQL", True
    cur = con.execute(oracles[name])
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    problem = compare(df.columns, got, want_cols, want)
    strict = problem is None and exact(df.columns, got, want_cols, want)
    return seconds, len(got), problem, strict


def main() -> int:
    from nivalgrid.catalog import ORACLES, QUERIES
    from tests.session import make_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        sf_dir, args = args[1], args[2:]
    names = [n for n in QUERIES if not args or any(n == a or n.startswith(a) for a in args)]
    spark, con, bad = make_session(), connect(sf_dir), 0
    for name in names:
        try:
            seconds, rows, problem, strict = run(spark, con, name, sf_dir, QUERIES, ORACLES)
        except Exception as err:  # noqa: BLE001
            seconds, rows, problem, strict = 0.0, 0, f"{type(err).__name__}: {str(err)[:700]}", False
        mark = "ok" if problem is None and strict else "no-sql" if problem == "no SQL" else "round" if problem is None else "BAD"
        bad += mark == "BAD"
        if mark == "round":
            problem = strict_difference(spark, con, name, sf_dir, QUERIES, ORACLES)
        print(f"{mark:7}{name:34}{rows:8d} {seconds:6.2f}s {problem if mark in ('BAD', 'round') else ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
