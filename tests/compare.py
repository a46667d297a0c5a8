"""Run registered queries against their SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def local_session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("lodestar-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.warehouse.dir", "/tmp/lodestar-warehouse")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return float(f"{value:.10g}") + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=lambda x: tuple((v is None, str(v)) for v in x))


def compare(spark, con, sf_dir, run, sql):
    """None when equal, else a short description of the difference."""
    df = run(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}: {got[:2]} {want[:2]}"
    for g, w in zip(got, want):
        if g != w or any(type(a) is not type(b) for a, b in zip(g, w)):
            return f"{cols}: {g} != {w}"
    return None if got else "no rows"


def main():
    from __spark_entry__ import oracle_sql, queries
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, sql = local_session(), duck(sf_dir), oracle_sql()
    names = sys.argv[2:] or list(queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            diff = compare(spark, con, sf_dir, queries()[name], sql.get(name))
        except Exception as err:  # report every query, whatever it raises
            diff = f"{type(err).__name__}: {str(err)[:400]}"
        bad += diff is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {diff or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
