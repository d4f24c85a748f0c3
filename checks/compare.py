"""Runs the registered queries next to their SQL and reports differences.

    python -m checks.compare [sf_dir] [query,query,...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from checks.oracle import oracle_sql
from checks.registry import QUERIES
from walksieve.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def in_name_order(columns: list[str], rows) -> Counter:
    """Rows as a bag, columns sorted by name; values by type and exact text."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple((type(row[i]).__name__, repr(row[i])) for i in order) for row in rows)


def compare(spark, connection, name: str, sf_dir: str, sql: str) -> str:
    """'' when both give the same rows, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    columns, rows = sql_rows(connection, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    ours, theirs = in_name_order(df.columns, df.collect()), in_name_order(columns, rows)
    if ours == theirs:
        return ""
    return (f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours "
            f"{list((ours - theirs).items())[:2]}; only SQL {list((theirs - ours).items())[:2]}")


def connect(sf_dir: str):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(QUERIES)
    spark, connection, sql = local_session(), connect(sf_dir), oracle_sql()
    spark.sparkContext.setLogLevel("ERROR")
    wrong = 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, connection, name, sf_dir, sql[name]) if name in sql \
                else f"no SQL, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as error:      # report and go on with the next query
            result = f"failed: {str(error)[:600]}"
        wrong += bool(result) and name in sql
        print(f"{name:26s} {time.time() - start:6.2f}s {result or 'equal'}", flush=True)
    print(f"{wrong} differ")
    return wrong


if __name__ == "__main__":
    sys.exit(main())
