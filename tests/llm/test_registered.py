"""Every dealt operator and the pipeline have a query; SQL agrees where there is some."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from carelattice.llm.registry import QUERIES, SQL
from tests.oracle import connect, differences


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    folder = "/root/testdata/sf0.001"
    assert differences(QUERIES[name](spark, folder), connect(folder), SQL[name]) == []


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe",
    ]
