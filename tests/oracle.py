"""Run registered queries next to their SQL: ``python tests/oracle.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def spark_session(cpus: int = 8):
    from pyspark.sql import SparkSession

    from inspectlake.session import configured

    spark = (
        configured(SparkSession.builder.master(f"local[{cpus}]"))
        .appName("inspectlake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(folder: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "as_integer_ratio"):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    )


def compare(spark, con, folder, build, sql):
    df = build(spark, folder)
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    d_cols, d_rows = rows_of([c[0] for c in rel.description], rel.fetchall())
    if s_cols != d_cols:
        return f"columns {s_cols} != {d_cols}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} != {len(d_rows)}; e.g. {s_rows[:1]} / {d_rows[:1]}"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        return f"{len(bad)}/{len(s_rows)} differ: {s_cols} {bad[0][0]} != {bad[0][1]}"
    return None if s_rows else "EMPTY"


def main(argv):
    import __spark_entry__ as e

    sf = argv[0] if argv else "0.01"
    prefixes = argv[1:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = spark_session(), duck(folder)
    queries, oracles, failed = e.queries(), e.oracle_sql(), 0
    for name, build in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                error = compare(spark, con, folder, build, oracles[name])
            else:
                count = build(spark, folder).count()
                error = None if count else "EMPTY"
        except Exception as exc:  # report and go on with the next query
            error = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += error is not None
        kind = "S" if name in oracles else "R"
        print(f"{'FAIL' if error else 'ok  '} {kind} {name} {time.time() - start:.1f}s {error or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
