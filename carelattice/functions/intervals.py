"""Joins of intervals that overlap, and of points with the intervals that hold them.

The bounds of both sides are put in one order, by key and time, which is cut into ranges at sampled
borders. Each range is swept for a running count of either side's starts, and the ranges' totals
shift the counts. The starts of one side that lie within an interval of the other then are consecutive
numbers, and these rows are fetched by blocks of numbers. The work is a sort and the pairs found, whatever
the intervals' length and however they overlap; no key, time or interval goes to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelattice.session import cut_lineage

#: Rows with numbers in a row that are fetched together. An interval is one row of the join for each
#: block it touches, and looks at no more than two blocks' rows that are not its own.
BLOCK_ROWS = 128
#: The blocks of so many rows of an interval are unfolded at a time.
PART_ROWS = 65_536


def _block(number: Column) -> Column:
    return F.floor(number / BLOCK_ROWS).cast("long")


def _edges(rows: DataFrame, prefix: str, keys: list[str], start: str, end: str | None, place: int) -> DataFrame:
    """A row for each bound, with the columns of `rows` renamed; an open start comes before everything
    and an open end after it. `place` orders starts of the two sides at the same time."""
    names = {c: f"_{prefix}_{c}" for c in rows.columns}
    held = rows.select(
        *keys, F.monotonically_increasing_id().alias("_id"), F.lit(prefix).alias("_side"),
        *[F.col(c).alias(n) for c, n in names.items()],
    )

    def edge(column: str, opened: int, at: int) -> Column:
        value = F.col(names[column])
        return F.struct(
            F.when(value.isNull(), opened).otherwise(0).alias("_open"), value.alias("_at"), F.lit(at).alias("_place")
        )

    bounds = [edge(start, -1, place)] + ([edge(end, 1, 2)] if end else [])
    return held.select("*", F.inline(F.array(*bounds)))


def _fetched(counted: DataFrame, own: str, other: str, columns: list[str]) -> DataFrame:
    """Intervals of the side `own` with the rows of the other one that start within them."""
    upto = F.col(f"_{other}s")
    spans = (
        counted.where(F.col("_side") == own)
        .groupBy("_id")
        .agg(
            F.min(upto).alias("_before"), F.max(upto).alias("_last"),
            *[F.any_value(c).alias(c) for c in columns if c.startswith(f"_{own}_")],
        )
        .where(F.col("_last") > F.col("_before"))
        .drop("_id")
    )
    starts = counted.where((F.col("_side") == other) & (F.col("_place") < 2)).select(
        upto.alias("_number"), *[c for c in columns if c.startswith(f"_{other}_")]
    )
    starts = starts.withColumn("_block", _block(F.col("_number")))
    first, last = _block(F.col("_before") + 1), _block(F.col("_last"))
    step = F.lit(max(1, PART_ROWS // BLOCK_ROWS)).cast("long")
    parts = spans.withColumn("_part", F.explode(F.sequence(first, last, step))).withColumn("_end", last)
    wanted = parts.withColumn(
        "_block", F.explode(F.sequence("_part", F.least(F.col("_part") + step - 1, F.col("_end"))))
    )
    # Sizes are estimated from compressed files of sorted numbers, far too small: never a broadcast.
    met = wanted.hint("merge").join(starts, "_block")
    return met.where("_number > _before and _number <= _last").select(*columns)


def overlapping(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_bounds: tuple[str, str | None],
    right_bounds: tuple[str, str],
    ranges: int | None = None,
) -> DataFrame:
    """All pairs with equal `keys` whose times overlap, bounds included; with the columns of both sides,
    named `_left_...` and `_right_...`.

    Bounds are the names of start and end; a null one is open. Without a left end the left rows are points
    in time, and those without a time are in no pair; nor are rows with a null key and intervals that end
    before they start. Rows that occur repeatedly are paired each. The order is cut into `ranges`, by
    default as many as the session has shuffle partitions.
    """
    (a, b), (c, d) = left_bounds, right_bounds
    for key in keys:
        left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    left = left.where(F.col(a).isNull() | F.col(b).isNull() | (F.col(a) <= F.col(b)) if b else F.col(a).isNotNull())
    right = right.where(F.col(c).isNull() | F.col(d).isNull() | (F.col(c) <= F.col(d)))
    if keys:
        # Left rows of keys that the right side lacks, or beyond all its times, meet nothing.
        reach = right.groupBy(*keys).agg(
            F.min(c).alias("_from"), F.max(d).alias("_to"),
            F.bool_or(F.col(c).isNull()).alias("_any_start"), F.bool_or(F.col(d).isNull()).alias("_any_end"),
        )
        ends = F.col(b) if b else F.col(a)
        left = (
            left.join(reach, keys)
            .where(F.col("_any_start") | ends.isNull() | (ends >= F.col("_from")))
            .where(F.col("_any_end") | F.col(a).isNull() | (F.col(a) <= F.col("_to")))
            .select(*left.columns)
        )
    sides = _edges(left, "left", keys, a, b, 1), _edges(right, "right", keys, c, d, 0)
    columns = [name for side in sides for name in side.columns if name.startswith(("_left_", "_right_"))]
    # Ids are given once: both bounds of an interval keep the same one.
    line = cut_lineage(sides[0].unionByName(sides[1], allowMissingColumns=True), "interval-line")
    order = [*keys, "_open", "_at", "_place", "_side", "_id"]
    cut = line.repartitionByRange(*([ranges] if ranges else []), *[F.col(name) for name in order])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    started = {
        f"_{side}s": F.sum(F.when((F.col("_side") == side) & (F.col("_place") < 2), 1).otherwise(0))
        for side in ("left", "right")
    }
    swept = cut_lineage(
        cut.withColumn("_range", F.spark_partition_id())
        .withColumns({name: sum_of.over(within) for name, sum_of in started.items()}),
        "interval-counts",
    )
    totals = swept.groupBy("_range").agg(*[F.max(name).alias(name) for name in started])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    shifts = totals.select(
        "_range", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before{name}") for name in started]
    )
    counted = swept.join(F.broadcast(shifts), "_range").withColumns(
        {name: F.col(name) + F.col(f"_before{name}") for name in started}
    )
    pairs = _fetched(counted, "right", "left", columns)
    return pairs if b is None else pairs.unionByName(_fetched(counted, "left", "right", columns))
