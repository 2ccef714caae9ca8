"""Run registered queries next to their SQL and report the differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, name: str, query, sql: str | None):
    started = time.time()
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, no SQL", took
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}", took
    if got != want:
        a = [r for r in got if r not in set(want)][:2] if len(got) < 200000 else []
        b = [r for r in want if r not in set(got)][:2] if len(got) < 200000 else []
        return False, f"rows {len(got)} vs {len(want)}\n   spark {str(a)[:700]}\n   sql   {str(b)[:700]}", took
    return True, f"{len(got)} rows", took


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from webtables import build_session
    from webtables.plans import all_queries, all_sql

    sf = argv[0]
    spark = build_session(
        "compare", "local[8]", spark_driver_memory="12g", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_ui_showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf), all_sql(), 0
    for name, query in all_queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            good, note, took = compare(spark, con, sf, name, query, sql.get(name))
        except Exception as e:
            good, note, took = False, f"{type(e).__name__}: {str(e)[:900]}", 0.0
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:34s} {took:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
