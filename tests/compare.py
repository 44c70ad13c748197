"""Run registered queries and their SQL twins side by side.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    text = frame.map(lambda v: "null" if v is None or v is pd.NA or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    if a.equals(b):
        return None
    bad = (a != b).any(axis=1)
    return f"{bad.sum()} rows differ\n{a[bad].head(4)}\n{b[bad].head(4)}"


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, failed = entry.queries(), entry.oracle_sql(), 0
    con = oracle_connection(sf_dir)
    for name in names or queries:
        try:
            at = time.time()
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - at
            if name not in sql:
                print(f"{name:28} rows {len(got):7} {took:6.2f}s  (rows only)", flush=True)
                continue
            at = time.time()
            want = con.execute(sql[name]).df()
            kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype]
            if kinds:
                print("   types:", kinds)
            bad = difference(got, want)
            print(f"{name:28} rows {len(got):7} {took:6.2f}s  sql {time.time() - at:5.2f}s  {bad or 'ok'}", flush=True)
            failed += bool(bad)
        except Exception as error:  # keep going: this is a report
            failed += 1
            print(f"{name:28} ERROR {str(error)[:1500]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
