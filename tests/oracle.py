"""Run registered queries beside their SQL and compare names, types and rows.

``python -m tests.oracle /root/testdata/sf0.01 [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()

# Spark type -> the DuckDB types that mean the same.
_SAME_TYPE = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "string": {"VARCHAR"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between the Spark result and the SQL result; empty when nothing does."""
    columns = sorted(df.columns)
    types = dict(df.dtypes)
    described = {
        r[0]: r[1] for r in connection.execute(f"DESCRIBE SELECT * FROM ({sql}) q").fetchall()
    }
    if columns != sorted(described):
        return [f"columns {columns} != {sorted(described)}"]
    found = [
        f"type of {c}: {types[c]} != {described[c]}"
        for c in columns
        if described[c] not in _SAME_TYPE.get(types[c], set())
    ]
    spark_rows = Counter(
        tuple(_plain(v) for v in row) for row in df.select(*columns).collect()
    )
    listed = ", ".join(f'"{c}"' for c in columns)
    sql_rows = Counter(
        tuple(_plain(v) for v in row)
        for row in connection.execute(f"SELECT {listed} FROM ({sql}) q").fetchall()
    )
    extra, lacking = spark_rows - sql_rows, sql_rows - spark_rows
    if extra or lacking:
        found.append(
            f"{spark_rows.total()} rows, {extra.total()} only in Spark {list(extra)[:2]},"
            f" {lacking.total()} only in SQL {list(lacking)[:2]}"
        )
    elif not spark_rows:
        found.append("no rows at all")
    return found


def main(folder: str, names: list[str]) -> None:
    import __spark_entry__ as spark_entry
    from carelattice.session import build_session

    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
           "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, sql = spark_entry.queries(), spark_entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            result = differences(df, connection, sql[name]) if name in sql else [str(df.count())]
        except Exception as error:
            result = [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{'ok  ' if not result else 'DIFF'} {name} {time.time() - start:.1f}s", *result,
              flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
