"""Ordering helpers against plain windows, with keys heavy enough to be cut."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carelattice.functions.ordered import Ordered, dense_numbers, first_rows


@pytest.fixture(scope="module")
def events(spark):
    # A third of the rows under one key, a fifth without key, equal times in between.
    key = (
        F.when(F.col("id") % 3 == 0, F.lit(7))
        .when(F.col("id") % 5 == 0, F.lit(None))
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(40)).cast("int"))
    )
    return spark.range(3_000).select(
        key.alias("k"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)).alias("t"), "id"
    )


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("split_above", [300, 10_000])
def test_ordered_equals_plain_windows(events, descending, split_above):
    odd = F.col("before") % 2
    got = (
        Ordered(events, ["k"], ["t", "id"], descending, split_above)
        .number("n")
        .previous(before="id", t_before="t")
        .running_sum("odds", odd)
        .total("rows", F.lit(1))
        .frame()
    )
    order = [F.desc(c) if descending else F.asc(c) for c in ("t", "id")]
    window = Window.partitionBy("k").orderBy(*order)
    plain = (
        events.withColumn("n", F.row_number().over(window).cast("long"))
        .withColumn("before", F.lag("id").over(window))
        .withColumn("t_before", F.lag("t").over(window))
        .withColumn("odds", F.sum(odd).over(window))
        .withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("k")))
        .withColumn("odds", F.coalesce("odds", F.lit(0)))
    )
    got = got.withColumn("odds", F.coalesce("odds", F.lit(0))).select(*plain.columns)
    assert got.exceptAll(plain).count() == 0
    assert got.count() == plain.count()


def test_a_hot_key_is_spread_over_window_groups(events):
    cut = Ordered(events, ["k"], ["t", "id"], split_above=300)
    largest = cut._df.groupBy("k", "_run").count().agg(F.max("count")).first()[0]
    assert largest < 150 < events.where("k = 7").count()


@pytest.mark.parametrize("parts", [1, 7])
def test_dense_numbers(events, parts):
    numbered = dense_numbers(events.repartition(parts), ["t", "id"], "n")
    plain = events.withColumn("n", F.row_number().over(Window.orderBy("t", "id")).cast("long"))
    assert numbered.exceptAll(plain).count() == 0
    assert numbered.count() == plain.count()


def test_first_rows_limits_before_the_shuffle(events):
    found = first_rows(events, ["k"], [F.asc("t"), F.asc("id")], 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert found.groupBy("k").count().agg(F.max("count")).first()[0] == 2
