"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "\0null"  # not the empty text
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        value = round(value, 6) + 0.0
        return repr(value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, key: str, query, oracle: str | None, sf_dir: str):
    """(ok, message) for one query."""
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - t
    if oracle is None:
        return True, f"{key}: rows-only {len(got)} ({took:.1f}s)"
    rel = con.execute(oracle)
    cols = [c[0] for c in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"{key}: columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return False, f"{key}: {len(got)} vs {len(want)} rows; spark-only {sorted(a)[:3]}; sql-only {sorted(b)[:3]} (cols {sorted(cols)}; {len(a)}/{len(b)} differ)"
    return True, f"{key}: ok {len(got)} rows ({took:.1f}s)"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "10g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf)
    import threading

    def stop(key: str) -> None:
        print("!!! stopped", key, flush=True)
        spark.sparkContext.cancelAllJobs()

    wanted = sys.argv[2:]
    sqls, bad = oracle_sql(), 0
    for k, q in queries().items():
        if wanted and k not in wanted:
            continue
        guard = threading.Timer(90, stop, [k])
        guard.start()
        try:
            ok, msg = compare(spark, connection, k, q, sqls.get(k), sf)
        except Exception as e:  # a failing query must not hide the others
            ok, msg = False, f"{k}: {type(e).__name__} {str(e)[:700]}"
        guard.cancel()
        bad += not ok
        print("   " if ok else "!!!", msg, flush=True)
    print("failed:", bad)
