"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py [sf] [name-prefix …]``."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(con, sql, df):
    """Empty text if both sides agree, else what differs."""
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    got = df.collect()
    if sorted(want_cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(want_cols)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a == b:
        return ""
    sa, sb = set(a), set(b)
    return (f"rows {len(a)} <> {len(b)}; only ours {sorted(sa - sb)[:3]}; only SQL {sorted(sb - sa)[:3]}"
            f" ({sorted(df.columns)})")


def main():
    from tests.conftest import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(), connect(sf_dir), 0
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                problem = compare(con, oracle[name], df)
            else:
                problem = "" if df.count() else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        took = time.time() - start
        if problem or took > 5:
            print(f"{name:35s} {took:6.1f}s {problem or 'ok'}", flush=True)
    print(f"done, {bad} bad")


if __name__ == "__main__":
    main()
