from __future__ import annotations

import datetime as dt

import pytest

from carelattice.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
           "spark.ui.enabled": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """``table("id int, name string", (1, "a"), (2, "b"))``"""
    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make


@pytest.fixture(scope="session")
def counted(spark):
    """``counted(df)``: the same rows, and an accumulator of how many were ever read."""
    def make(df):
        read, schema = spark.sparkContext.accumulator(0), df.schema

        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, schema), read

    return make


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def rows(df, *columns):
    """The rows as a sorted list of tuples, nulls first."""
    picked = df.select(*columns) if columns else df
    return sorted(map(tuple, picked.collect()), key=lambda r: [(v is not None, v) for v in r])
