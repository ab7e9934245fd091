"""Compare registered queries with their SQL: ``python tests/check_oracle.py [sf] [query ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def bag(rows: list, order: list[int]) -> list:
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """None if equal, else what differs: names, Python types, rows."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    relation = connection.sql(oracle_sql()[name])
    ours, theirs = df.columns, relation.columns
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} vs {sorted(theirs)}"
    kinds = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean"}
    sql_types = {n: kinds.get(str(t), str(t)) for n, t in zip(theirs, relation.types)}
    wrong = {n: (t, sql_types[n]) for n, t in df.dtypes if t != sql_types[n]}
    if wrong:
        return f"types {wrong}"
    left = bag(df.collect(), [ours.index(n) for n in sorted(ours)])
    right = bag(relation.fetchall(), [theirs.index(n) for n in sorted(ours)])
    if left == right:
        return None if left else "no rows"
    extra, missing = sorted(set(left) - set(right), key=repr), sorted(set(right) - set(left), key=repr)
    return f"{len(left)} vs {len(right)} rows; only ours {extra[:3]}; only theirs {missing[:3]}"


def main() -> int:
    from __spark_entry__ import oracle_sql
    from stopwise.session import build_session

    args = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{args.pop(0) if args and args[0][0].isdigit() else '0.01'}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = connect(sf_dir), 0
    for name in args or oracle_sql():
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
