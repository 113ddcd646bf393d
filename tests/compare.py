"""Runs ready queries next to their SQL on the same tables and compares the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
INTS = {"tinyint", "smallint", "int", "bigint", "INTEGER", "BIGINT", "SMALLINT", "TINYINT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        return ("float", v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return ("time", v.isoformat())
    return (type(v).__name__, v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kind(t: str) -> str:
    t = t.lower()
    return {"integer": "int", "varchar": "string", "timestamp_ntz": "timestamp"}.get(t, t)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return took, len(got), None
    ref = con.execute(sql)
    columns = [d[0] for d in ref.description]
    types = {d[0]: kind(str(d[1])) for d in ref.description}
    want = ref.fetchall()
    problems = []
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    else:
        for c, t in df.dtypes:
            if kind(t) != types[c]:
                problems.append(f"type {c}: {t} != {types[c]}")
        a, b = rows_of(df.columns, got), rows_of(columns, want)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            problems.append(f"rows {len(a)} vs {len(b)}; columns {sorted(columns)}; first differences {str(diff)[:900]}")
    if not got:
        problems.append("no rows")
    return took, len(got), problems


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    import __spark_entry__ as entry

    chosen = sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if chosen and not any(name == c or (c.endswith("*") and name.startswith(c[:-1])) for c in chosen):
            continue
        try:
            took, n, problems = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            took, n, problems = 0.0, 0, [f"{type(exc).__name__}: {str(exc)[:700]}"]
        state = "rows only" if problems is None else "ok" if not problems else "BAD"
        bad += state == "BAD"
        print(f"{name:24s} {state:9s} {n:8d} rows {took:6.2f}s", *(problems or []), flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
