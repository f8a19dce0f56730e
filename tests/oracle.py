"""Run queries next to DuckDB on the same tables and compare as multisets."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(r[i] for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    """None when equal, else a message."""
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = got - want, want - got
        return (f"{sum(got.values())} rows, {sum(want.values())} wanted; "
                f"extra {list(extra.items())[:3]} missing {list(missing.items())[:3]}")
    return None if want else "empty on both sides"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tidemark import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            problem = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
