"""Run registered queries next to their SQL statements and compare row by row.

``python -m tests.compare [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def difference(spark_df, con, statement):
    """None when both sides hold the same rows under the same names and types, else a short text."""
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    ours_typed = sorted((name, TYPES.get(kind, kind)) for name, kind in spark_df.dtypes)
    theirs_typed = sorted((d[0], str(d[1])) for d in result.description)
    if ours_typed != theirs_typed:
        return f"columns {set(ours_typed) ^ set(theirs_typed)}"
    theirs = rows_of(names, result.fetchall())
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if ours == theirs:
        return None
    mine, other = set(ours) - set(theirs), set(theirs) - set(ours)
    return f"{len(ours)} rows vs {len(theirs)}; ours only {sorted(mine)[:3]}; theirs only {sorted(other)[:3]}"


def main(folder: str, only: list[str]) -> int:
    from metricloom import plans
    from metricloom.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                          "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    statements, bad = plans.statements(), 0
    for name, build in plans.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in statements:
                problem = difference(df, con, statements[name])
                note = problem or f"equal, {df.count() if problem is None else ''} rows"
            else:
                problem, note = None, f"rows only, {df.count()} rows"
        except Exception as error:
            problem = note = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {time.time() - start:5.1f}s {note}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])))
