"""Run queries beside their oracles: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    return v


def bag(columns, rows) -> Counter:
    """Rows as a multiset, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark, con, sf: str, name: str, queries, oracles) -> str | None:
    """None when the query equals its oracle."""
    df = queries[name](spark, f"{DATA}/sf{sf}")
    rows = [tuple(r) for r in df.collect()]
    if name not in oracles:
        return None if rows else "no rows"
    result = con.execute(oracles[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    ours, theirs = bag(df.columns, rows), bag(columns, expected)
    if ours != theirs:
        return (f"{len(rows)} rows, {len(expected)} expected; columns {sorted(columns)}; "
                f"only ours {list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}")
    return None


def main() -> int:
    import __spark_entry__ as entry
    from stayline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, con, sf, name, queries, oracles)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        state = "ok" if problem is None else "FAIL"
        kind = "sql" if name in oracles else "rows"
        print(f"{state:4} {kind:4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
