"""One key with a third of all rows: joins are split, aggregates shrink before the shuffle."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from carelattice.operators import charts, quality, writes

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    collected = df._jdf.queryExecution()
    df.collect()
    return collected.executedPlan().toString()


def test_a_hot_encounter_splits_the_chart_join(spark, skewed):
    encounters = spark.range(5_000).select("id", (F.col("id") % 700).alias("patient_id"))
    hot = F.when(F.col("id") % 3 == 0, F.lit(4)).otherwise(F.col("id") % 5_000)
    records = spark.range(0, 60_000, 1, 8).select(
        hot.alias("encounter_id"), "id", F.sha2(F.col("id").cast("string"), 256).alias("title")
    )
    found = charts.chart_rows(encounters, records)
    assert "skew=true" in final_plan(found)
    assert found.count() == 60_000 + encounters.join(
        records, F.col("encounter_id") == encounters["id"], "left_anti"
    ).count()


def test_hot_slots_shrink_before_the_shuffle(spark, skewed):
    requests = spark.range(0, 30_000, 1, 4).select(
        "id",
        F.col("id").alias("request_id"),
        F.timestamp_seconds("id").alias("requested_at"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("slot_id"),
        F.lit("confirmed").alias("status"),
    )
    won = writes.winning_requests(requests, requests.where("id < 0"))
    assert re.search(r"WindowGroupLimit.*Partial", final_plan(won))
    assert won.count() == 20_001 - 1
    double = quality.double_booked_slots(requests)
    assert "partial_count" in final_plan(double)
    assert [tuple(r) for r in double.collect()] == [(1, 10_001)]
