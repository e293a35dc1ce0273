"""Run registered queries beside their SQL twins: python -m tests.compare SF [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, sf_dir, name, fn, sql):
    """Empty string when equal, else what differs."""
    df = fn(spark, sf_dir)
    left, left_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "", len(left)
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    right, right_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    spark_types = dict(df.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}:{spark_types[c]}/{types.get(c)}" for c in left_cols if same.get(spark_types[c], types.get(c)) != types.get(c)]
    if left_cols != right_cols:
        return f"columns {left_cols} vs {right_cols}", len(left)
    if odd:
        return f"types {odd}", len(left)
    if left != right:
        a, b = set(left), set(right)
        return f"rows {len(left)} vs {len(right)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}", len(left)
    return "", len(left)


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from lodestone.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    sf_dir = f"{ROOT}/sf{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), []
    for name, fn in queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            problem, count = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as error:  # noqa: BLE001 - a report over all queries
            problem, count = f"{type(error).__name__}: {str(error)[:700]}", -1
        mark = "FAIL" if problem else ("ok" if name in sqls else "rows")
        print(f"{mark:5}{time.time() - start:6.1f}s {name} rows={count} {problem}", flush=True)
        bad += [name] if problem else []
    print("failed:", bad)


if __name__ == "__main__":
    main()
