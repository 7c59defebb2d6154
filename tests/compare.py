"""Run registered queries next to their checking SQL and compare whole results.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

DATA = os.environ.get("TILLFLOW_TESTDATA", "/root/testdata")


def duck(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def compare(spark_df, con, sql) -> str | None:
    """None if both give the same columns, types and rows, else what differs."""
    cur = con.execute(sql)
    columns = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    if set(columns) != set(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    for name, kind in spark_df.dtypes:
        if KINDS.get(kind, kind) != columns[name]:
            return f"type of {name}: {kind} != {columns[name]}"
    got = rows_of(spark_df.columns, spark_df.collect())
    want = rows_of(list(columns), expected)
    if got != want:
        only_got, only_want = list(set(got) - set(want)), list(set(want) - set(got))
        return (f"{len(got)} rows != {len(want)} rows; columns {sorted(columns)}; only here {only_got[:2]}; "
                f"only in SQL {only_want[:2]}")
    if not got:
        return "no rows"
    return None


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tillflow")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("FATAL")  # state stores log noisy errors when a session ends
    return spark


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    folder = f"{DATA}/sf{args.sf}"
    spark, con = session(), duck(folder)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), []
    for name in args.names or queries:
        began = time.time()
        try:
            df = queries[name](spark, folder)
            problem = (compare(df, con, oracles[name]) if name in oracles
                       else None if df.count() else "no rows")
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'FAIL' if problem else 'ok  '} {name} {'' if name in oracles else '(rows only) '}"
              f"{time.time() - began:.1f}s {problem or ''}", flush=True)
        bad += [name] if problem else []
    print("failed:", bad)
