"""Compare registered queries with their SQL on DuckDB.

``python -m logfault.plans.check [folder] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)) and not hasattr(value, "_fields"):
        return tuple(_norm(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, folder, name, fn, sql):
    """Returns (problem or None, rows, spark seconds, duckdb seconds)."""
    import duckdb

    start = time.time()
    df = fn(spark, folder)
    got = [tuple(row) for row in df.collect()]
    spent = time.time() - start
    if sql is None:
        return None, len(got), spent, 0.0
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    start = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    oracle_spent = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got), spent, oracle_spent
    a, b = _rows(df.columns, got), _rows(columns, want)
    if a == b:
        return None, len(got), spent, oracle_spent
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(got), spent, oracle_spent
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, columns {sorted(columns)}, first {bad[0]}", len(got), spent, oracle_spent


def main(argv):
    from ..session import build_session
    from . import ORACLE, QUERIES

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("check", "local[8]", 8, **{"spark.driver.memory": "12g",
                                                     "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, rows, spent, oracle_spent = compare(spark, folder, name, fn, ORACLE.get(name))
        except Exception as error:  # report and go on with the next query
            problem, rows, spent, oracle_spent = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0.0, 0.0
        failed += problem is not None
        kind = "ok" if problem is None else "FAIL"
        if problem is None and name not in ORACLE:
            kind = "rows"
        print(f"{kind:5} {name:34} rows={rows:<7} spark={spent:6.2f}s duckdb={oracle_spent:6.2f}s {problem or ''}",
              flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
