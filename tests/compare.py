"""Compare Spark queries with their SQL in DuckDB, as sets of rows (run as a script for any names)."""

from __future__ import annotations

import datetime
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, bool):
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return int(v) if not isinstance(v, str) and hasattr(v, "__index__") else v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(d)):
        path = os.path.join(d, f)
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def differences(spark, d: str, name: str) -> tuple[int, str]:
    """Number of rows and '' if equal, else what differs."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, d)
    got = rows_of(df.columns, df.collect())
    cur = duck(d).execute(e.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    if sorted(cols) != sorted(df.columns):
        return sum(got.values()), f"columns {sorted(df.columns)} and {sorted(cols)}"
    want = rows_of(cols, cur.fetchall())
    if got == want:
        return sum(got.values()), ""
    return sum(got.values()), f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want))[:3]}; only SQL {list((want - got))[:3]}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="compare-checkpoint-"))
    return spark


if __name__ == "__main__":
    import __spark_entry__ as e

    s, where = session(), f"/root/testdata/{sys.argv[1]}"
    for q in e.queries():
        if len(sys.argv) == 2 or any(q.startswith(x) for x in sys.argv[2:]):
            began = time.time()
            if q in e.oracle_sql():
                n, diff = differences(s, where, q)
            else:
                n, diff = e.queries()[q](s, where).count(), "no SQL"
            print(f"{q}: {n} rows, {time.time() - began:.1f} s {diff or 'equal'}", flush=True)
