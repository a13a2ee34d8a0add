"""Run registered queries next to their SQL in DuckDB and compare. Usage: check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from evidentia.plans.catalog import registered
from evidentia.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """(rows, seconds, problem)"""
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return len(rows), took, None
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    expected = rel.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(rows), took, f"columns {sorted(df.columns)} != {sorted(columns)}"
    wanted = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in rel.description}
    if wanted != dict(df.dtypes):
        return len(rows), took, f"types {sorted(set(df.dtypes) - set(wanted.items()))} != {sorted(set(wanted.items()) - set(df.dtypes))}"
    if len(rows) != len(expected):
        return len(rows), took, f"rows {len(rows)} != {len(expected)}"
    ours, theirs = normal(df.columns, rows), normal(columns, expected)
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return len(rows), took, f"{len(bad)} rows differ, first {bad[:3]}"
    return len(rows), took, None


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    queries, sql = registered()
    spark, con = local_session("8"), connect(sf_dir)
    failed = 0
    for name in args[1:] or queries:
        try:
            n, took, problem = compare(spark, con, queries[name], sql.get(name), sf_dir)
        except Exception as e:  # report and go on
            n, took, problem = 0, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        state = "FAIL" if problem else ("ok" if name in sql else "rows")
        print(f"{state:5}{name:28}{n:8d} rows {took:7.2f} s  {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
