"""Run queries against their oracle: ``python tests/check_queries.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, expected_rows, expected_types, rows_of, type_names  # noqa: E402

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from assetlake.session import session  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    if os.environ.get("PLAIN_SESSION"):  # as a driver with its own settings would start it
        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        spark = session(
            "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
            spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
        )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = rows_of(df)
            took = time.time() - started
            if name not in oracles:
                print(f"rows {name}: {sum(got.values())} rows, {took:.2f}s", flush=True)
                continue
            columns, want = expected_rows(con, oracles[name])
            if columns != sorted(df.columns):
                print(f"FAIL {name}: columns {sorted(df.columns)} want {columns}", flush=True)
                failed += 1
            elif got != want:
                failed += 1
                print(f"FAIL {name}: {sum(got.values())} rows want {sum(want.values())}; "
                      f"extra {list((got - want).items())[:2]} missing {list((want - got).items())[:2]}"[:900], flush=True)
            else:
                mine, theirs = type_names(df), expected_types(con, oracles[name])
                odd = {c: (mine[c], theirs[c]) for c in mine if mine[c] != theirs[c]}
                print(f"ok   {name}: {sum(got.values())} rows, {took:.2f}s {odd or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
