"""Compare registered queries with their SQL: python -m workload.check [folder] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"{name}: {len(got)} rows, {took:.1f}s (no SQL)"
    start = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    sql_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(got, df.columns), rows_of(want, names)
    if a != b:
        left, right = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return False, f"{name}: {len(a)} rows vs {len(b)}; {sorted(names)}\n   spark {left}\n   sql   {right}"
    return True, f"{name}: {len(a)} rows, {took:.1f}s (SQL {sql_took:.1f}s)"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from . import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        try:
            ok, text = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as err:  # report and go on with the next query
            ok, text = False, f"{name}: {type(err).__name__}: {str(err)[:1500]}"
        bad += not ok
        print("ok  " if ok else "BAD ", text, flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
