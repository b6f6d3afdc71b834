"""Runs registered queries next to their SQL twins: ``python -m tests.oracle [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("tallyloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree exactly, otherwise a description of the difference."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _rows(df.columns, got), _rows(rel.columns, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(i) for i in x] != [type(i) for i in y]]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {sorted(df.columns)}\n   {bad[0][0]}\n   {bad[0][1]}" if bad else None


def main(argv: list[str]) -> int:
    from tallyloom.catalog import ORACLES, QUERIES

    sf = argv[0] if argv and argv[0][0] in "0123456789" else "0.01"
    names = [a for a in argv if a and a[0] not in "0123456789"] or list(QUERIES)
    names = [n for a in names for n in QUERIES if n == a or (a.endswith("*") and n.startswith(a[:-1]))]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, failed = session(), duck(sf_dir), 0
    for name in names:
        t = time.time()
        try:
            if name in ORACLES:
                problem, kind = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir), "sql"
            else:
                n = len(QUERIES[name](spark, sf_dir).collect())
                problem, kind = (None if n else "no rows"), f"rows={n}"
        except Exception as e:  # report and go on with the next query
            problem, kind = f"{type(e).__name__}: {str(e)[:900]}", "error"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {kind} {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
