"""Runs registered queries against their SQL: ``python tests/compare.py sf_dir [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    """Rows with columns in name order, sorted, floats rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if ours else "no rows"
    t0 = time.time()
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    names = sorted(c[0] for c in cur.description)
    if time.time() - t0 > 5:
        print(f"     SQL took {time.time() - t0:.1f}s")
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {names}"
    if not ours:
        return "no rows"
    if ours == theirs:
        return None
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"{len(ours)} / {len(theirs)} rows; only ours {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"


def main() -> None:
    from clauselens.catalogue.registry import ORACLES, QUERIES
    from clauselens.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - t:.1f}s {(problem or '')[:900]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
