"""Runs queries and their SQL over one data directory and compares the rows: python -m tests.oracle [dir] [prefix ...]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from evidex.session import TABLES, build_session


def plain(v):
    """A value that compares alike from both engines."""
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connection(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = Path(d, f"{t}.parquet")
        if p.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def differences(spark, c, query, sql: str, d: str) -> str:
    """'' if the query and the SQL give the same rows under the same names, else what differs."""
    df = query(spark, d)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(r[k]) for k in cols) for r in df.collect())
    rel = c.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(k) for k in cols]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only mine {list((mine - theirs).items())[:2]}; only theirs {list((theirs - mine).items())[:2]}"


def main(args: list[str]) -> int:
    import __spark_entry__ as e

    d = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    c, bad, sql = connection(d), 0, e.oracle_sql()
    for name, q in e.queries().items():
        if args[1:] and not any(name.startswith(p) for p in args[1:]):
            continue
        t = time.time()
        try:
            said = differences(spark, c, q, sql[name], d) if name in sql else f"(no SQL) {len(q(spark, d).take(5))} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:300]}"
        bad += bool(said) and not said.startswith("(no SQL)")
        print(f"{name}: {said or 'same'} [{time.time() - t:.1f} s]" if said or "-v" in args else f"{name}: same", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
