"""Compares a Spark query with its SQL equivalent in DuckDB on the same files."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    return repr(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def duck_rows(folder: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    cursor = con.execute(sql)
    return normal_rows([d[0] for d in cursor.description], cursor.fetchall())


def spark_rows(df):
    return normal_rows(df.columns, [tuple(r) for r in df.collect()])


def differences(spark, folder: str, name: str, queries, oracles) -> str | None:
    columns, rows = spark_rows(queries[name](spark, folder))
    wanted_columns, wanted = duck_rows(folder, oracles[name])
    if columns != wanted_columns:
        return f"columns {columns} instead of {wanted_columns}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows instead of {len(wanted)}"
    wrong = [(a, b) for a, b in zip(rows, wanted) if a != b]
    return f"{len(wrong)} rows differ, first: {wrong[0]}" if wrong else None


def main(folder: str, names):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import new_session

    spark = new_session()
    known, oracles = queries(), oracle_sql()
    for name in names or known:
        start = time.time()
        try:
            if name in oracles:
                problem = differences(spark, folder, name, known, oracles)
            else:
                rows = known[name](spark, folder).collect()
                problem = None if rows else "no rows"
                print("   ", *rows[:20], sep="\n    ")
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        state = "ok  " if problem is None else "FAIL"
        print(f"{state} {name:28s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
