"""Run registered queries and their SQL side by side and compare rows, names and types.

    python tools/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from fleetlens.plans.catalog import QUERIES  # noqa: E402
from fleetlens.session import build  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

KINDS = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "decimal(38,0)": "DECIMAL(38,0)",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows_of(rows: list, order: list[int]) -> Counter:
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(frame: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between a frame and a SQL result; empty when they agree."""
    shown = con.execute(sql)
    names = [d[0] for d in shown.description]
    types = [str(d[1]) for d in shown.description]
    want = shown.fetchall()
    problems = []
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} vs {sorted(names)}"]
    for name, kind in frame.dtypes:
        other = types[names.index(name)]
        if KINDS.get(kind) != other:
            problems.append(f"type of {name}: {kind} vs {other}")
    cols = sorted(names)
    got = frame.collect()
    left = rows_of(got, [frame.columns.index(c) for c in cols])
    right = rows_of(want, [names.index(c) for c in cols])
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    if left != right:
        problems.append(f"only spark {list((left - right).items())[:2]}; only sql {list((right - left).items())[:2]}")
    if not got:
        problems.append("empty result")
    return problems


def session() -> SparkSession:
    spark = build(
        "compare",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = session(), connect(folder)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            q = QUERIES[name]
            problems = compare(q.frame(spark, folder), con, q.oracle())
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{bad} of {len(args.names or QUERIES)} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
