"""Compare registered queries with their SQL twins: columns, types, row count, values.

    python -m tests.oracle [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "int": "int", "bigint": "bigint", "string": "string", "double": "double", "boolean": "boolean",
    "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamp",
    "INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty when the two agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    problems = []
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if sorted(names) != sorted(kinds):
        return [f"columns {sorted(kinds)} against {sorted(names)}"]
    wanted = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    for n in sorted(names):
        if wanted[n] != kinds[n]:
            problems.append(f"type of {n}: {kinds[n]} against {wanted[n]}")
    order = sorted(names)
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    theirs = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in cur.fetchall()), key=key)
    mine = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=key)
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} rows against {len(theirs)}")
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        problems.append(f"only ours: {sorted(a - b)[:3]}; only theirs: {sorted(b - a)[:3]}")
    if not mine:
        problems.append("no rows")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import local_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--plain", action="store_true", help="a session with Spark's own defaults")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = SparkSession.builder.master("local[8]").getOrCreate() if opts.plain else local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(opts.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if opts.names and not any(n in name for n in opts.names):
            continue
        start = time.time()
        try:
            df = fn(spark, opts.sf)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                note = ""
            else:
                rows = df.collect()
                problems, note = ([] if rows else ["no rows"]), f"rows only: {len(rows)}"
        except Exception as e:
            problems, note = [f"{type(e).__name__}: {str(e)[:1500]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
