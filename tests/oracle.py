"""Compare queries with their SQL: ``python tests/oracle.py sf_dir [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both sides give the same columns and rows, else a short account of the difference."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    if sorted(sql_columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    want = rows_of(sql_columns, result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:2]
    lost = [r for r in want if r not in set(got)][:2]
    return f"rows {len(got)} vs {len(want)}; only here {extra}; only in SQL {lost}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from fretwork.session import build_session

    spark = build_session("oracle", "local[8]", 8, {"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, sqls = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            verdict = difference(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as error:
            verdict = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.2f}s  {verdict or 'ok'}", flush=True)
    spark.stop()
