"""Runs registered queries and their SQL side by side.

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""
from __future__ import annotations

import datetime
import decimal
import logging
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    """A value as text; whole numbers and floats stay apart, as they would in a strict check."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, (float, decimal.Decimal)):
        return f"f:{float(v):.9g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return f"d:{v}"
    return f"s:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs first."""
    df = fn(spark, sf_dir)
    a_cols, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b_cols, b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} / {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}: {next(iter(set(a) - set(b)), None)} / {next(iter(set(b) - set(a)), None)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows\n   {bad[0][0]}\n   {bad[0][1]}" if bad else None


def main() -> int:
    import __spark_entry__ as entry
    from glassledger.session import local_session

    logging.disable(logging.CRITICAL)
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        t = time.time()
        try:
            if name in sqls:
                diff = compare(spark, con, queries[name], sqls[name], sf_dir)
                state = "ok" if diff is None else f"DIFF {diff}"
            else:
                n = queries[name](spark, sf_dir).count()
                diff, state = None, f"rows only: {n}"
        except Exception as e:
            diff = state = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        failed += diff is not None
        print(f"{time.time() - t:6.1f}s {name}: {state}", flush=True)
    print(f"{failed} failed", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
