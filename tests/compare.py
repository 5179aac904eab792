"""Run registered queries beside their SQL on DuckDB and compare the rows.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def normal(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_rows, spark_columns, sql_rows, sql_columns) -> str | None:
    if sorted(spark_columns) != sorted(sql_columns):
        return f"columns {sorted(spark_columns)} != {sorted(sql_columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows != {len(sql_rows)}"
    left, right = normal(spark_rows, spark_columns), normal(sql_rows, sql_columns)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def check(spark, con, sf_dir: str, name: str, query, sql: str | None) -> tuple[str | None, int]:
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None, len(rows)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return difference(rows, df.columns, found.fetchall(), columns), len(rows)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from bench import session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con, sql = session(), connect(sf), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem, n = check(spark, con, sf, name, query, sql.get(name))
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += problem is not None
        state = "BAD " + problem if problem else "ok" if name in sql else "rows only"
        print(f"{name:26s} {n:8d} {time.time() - start:6.1f}s  {state}", flush=True)
    print("failed:", bad)
