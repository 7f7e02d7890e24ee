"""Run registered queries beside their SQL and compare values: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from proratio.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    """Equal values compare equal, whatever their scale; kinds stay apart."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("dec", value.normalize() + 0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None):
        return value.replace(tzinfo=None)
    return value


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    df = queries()[name](spark, folder)
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(ours)}"
    cursor = con.execute(sql)
    theirs_columns = [c[0] for c in cursor.description]
    if sorted(theirs_columns) != columns:
        return False, f"columns {columns} != {sorted(theirs_columns)}"
    order = [theirs_columns.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    a, b = Counter(ours), Counter(theirs)
    if a == b:
        return True, f"{len(ours)} rows"
    return False, f"{len(ours)} vs {len(theirs)} rows; only ours {list((a - b))[:2]}; only sql {list((b - a))[:2]}"


if __name__ == "__main__":
    folder = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    names = sys.argv[2:] or list(queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    sys.exit(bool(bad))
