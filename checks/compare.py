"""Run registered queries next to their DuckDB text: python -m checks.compare [sf] [key ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)
    return names, body


def differences(df, con, sql) -> list[str]:
    """Empty when columns, row count and every value agree."""
    names, got = normalized(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    wanted_names, wanted = normalized([c[0] for c in result.description], result.fetchall())
    if names != wanted_names:
        return [f"columns {names} != {wanted_names}"]
    if len(got) != len(wanted):
        return [f"rows {len(got)} != {len(wanted)}"]
    return [f"{a} != {b}" for a, b in zip(got, wanted) if a != b or list(map(type, a)) != list(map(type, b))]


def main(argv: list[str]) -> int:
    from checks.registry import ORACLES, QUERIES

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    keys = argv[1:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for key in keys:
        started = time.time()
        try:
            df = QUERIES[key](spark, sf_dir)
            wrong = differences(df, con, ORACLES[key]) if key in ORACLES else (
                [] if df.count() else ["no rows"])
        except Exception as error:  # report every key
            wrong = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(wrong)
        kind = "oracle" if key in ORACLES else "rows"
        print(f"{'FAIL' if wrong else 'ok':4} {kind:6} {key} {time.time() - started:.1f}s {len(wrong)} "
              + "\n".join(wrong[:3]), flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
