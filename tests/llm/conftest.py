from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, keep_id string, score string, fingerprint string"


@pytest.fixture(scope="session")
def docs(spark):
    """``docs((1, "text"), ...)``: documents with columns whose names clash with results."""
    def make(*rows):
        return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def given(spark):
    """The smallest given table, and its rows."""
    folder = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    return folder, frame, [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
