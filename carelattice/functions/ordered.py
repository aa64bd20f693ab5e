"""Ordering within a key, safe when one key holds a large share of all rows.

A window over a key sends all of the key's rows to one task. Here the rows per key
are counted first (one narrow aggregation). Where no key is oversized, a plain window
does the work. Otherwise every oversized key is cut into as many runs as its rows ask for, at
values sampled from its own order columns; the window then works per (key, run), and a small
per-run summary carries counts, sums and last rows over the run borders. Results
equal the plain window's: the sample only decides where the cuts fall.

There are at most rows / SPLIT_ABOVE oversized keys and about four times as many runs: this is
the size of all that is broadcast here, a few millionths of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelattice.session import cut_lineage

# Keys below this many rows are left whole; larger ones are cut into runs of about a quarter.
SPLIT_ABOVE = 1_000_000
# Sampled positions per run.
SAMPLES_PER_RUN = 4


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on `keys` where null equals null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for i, k in enumerate(keys):
        match = left[k].eqNullSafe(renamed[f"_right_{k}"])
        condition = match if i == 0 else condition & match
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def _cuts(positions: Column, runs: Column) -> Column:
    """Every n-th of the sorted sampled positions, so that about `runs` remain."""
    step = F.greatest(F.lit(1), F.floor(F.size(positions) / runs).cast("int"))
    return F.filter(positions, lambda p, i: (i + 1) % step == 0)


class Ordered:
    """Rows of `df` in order within each key.

    `order` must identify a row within its key up to exact copies, or ties fall
    in no fixed order. With `descending` every order column runs downwards.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        descending: bool = False,
        split_above: int = SPLIT_ABOVE,
    ):
        self.keys = keys
        self.order = order
        self.descending = descending
        self._groups = keys
        self._df = df
        hot = (
            df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") >= split_above)
            .withColumn("_runs", F.ceil(F.col("_rows") * 4 / split_above))
        )
        hot = cut_lineage(hot, "hot-keys")
        if not hot.isEmpty():
            self._cut(hot)

    def _cut(self, hot: DataFrame) -> None:
        """Add `_run`, and `_split` for the keys that are cut."""
        position = F.struct(*self.order)
        rate = F.greatest(F.lit(1), F.floor(F.col("_rows") / (F.col("_runs") * SAMPLES_PER_RUN)))
        cuts = (
            null_safe_join(
                self._df.select(*self.keys, position.alias("_position")),
                F.broadcast(hot), self.keys, "inner",
            )
            .where(F.pmod(F.xxhash64("_position"), rate) == 0)
            .groupBy(*self.keys)
            .agg(
                F.array_sort(F.collect_set("_position")).alias("_sampled"),
                F.max("_runs").alias("_runs"),
            )
            .select(*self.keys, _cuts(F.col("_sampled"), F.col("_runs")).alias("_cuts"))
        )
        beyond = (lambda c: c > position) if self.descending else (lambda c: c <= position)
        self._df = null_safe_join(self._df, F.broadcast(cuts), self.keys, "left").select(
            *self._df.columns,
            F.col("_cuts").isNotNull().alias("_split"),
            F.coalesce(F.size(F.filter("_cuts", beyond)), F.lit(0)).alias("_run"),
        )
        # `_split` follows from the key; as a window key it lets the filter of `_carry`
        # reach the scan, so summaries read the cut keys only.
        self._groups = [*self.keys, "_run", "_split"]

    def _window(self):
        directed = [F.desc(c) if self.descending else F.asc(c) for c in self.order]
        return Window.partitionBy(*self._groups).orderBy(*directed)

    @property
    def _is_cut(self) -> bool:
        return self._groups is not self.keys

    def _carry(self, df: DataFrame, name: str, per_run: Column, over_runs) -> DataFrame:
        """Add what the runs before a row's own run amount to; null where there are none.

        The summary has a row per cut key and run, about 4 rows / SPLIT_ABOVE in all,
        so it is broadcast.
        """
        if not self._is_cut:
            return df.withColumn(name, F.lit(None))
        runs = self._df.where("_split").groupBy(*self.keys, "_run").agg(per_run.alias("_one"))
        before = Window.partitionBy(*self.keys).orderBy("_run")
        carry = runs.select(*self.keys, "_run", over_runs(F.col("_one"), before).alias(name))
        return null_safe_join(df, F.broadcast(carry), [*self.keys, "_run"], "left")

    @staticmethod
    def _sum_before(one: Column, before) -> Column:
        return F.sum(one).over(before.rowsBetween(Window.unboundedPreceding, -1))

    def number(self, name: str) -> Ordered:
        """Add the row number within the key, from 1."""
        local = self._df.withColumn(name, F.row_number().over(self._window()).cast("long"))
        carried = self._carry(local, "_before", F.count(F.lit(1)), self._sum_before)
        self._df = carried.withColumn(
            name, F.col(name) + F.coalesce("_before", F.lit(0).cast("long"))
        ).drop("_before")
        return self

    def previous(self, **values: str) -> Ordered:
        """Add columns with the value of the previous row of the key, null on the first."""
        held = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
        position = F.struct(*self.order)
        last = F.min_by(held, position) if self.descending else F.max_by(held, position)
        local = self._df.withColumn("_previous", F.lag(held).over(self._window()))
        carried = self._carry(local, "_last", last, lambda one, before: F.lag(one).over(before))
        self._df = carried.withColumn("_previous", F.coalesce("_previous", "_last")).select(
            *self._df.columns, *[F.col(f"_previous.{n}").alias(n) for n in values]
        )
        return self

    def running_sum(self, name: str, value: Column) -> Ordered:
        """Add the sum of `value` from the first row of the key up to this row."""
        self._df = self._df.withColumn("_value", value)
        frame = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = self._df.withColumn(name, F.sum("_value").over(frame))
        carried = self._carry(local, "_before", F.sum("_value"), self._sum_before)
        self._df = carried.withColumn(
            name, F.col(name) + F.coalesce("_before", F.lit(0).cast("long"))
        ).drop("_before", "_value")
        return self

    def running_min(self, name: str, value: Column) -> Ordered:
        """Add the smallest `value` from the first row of the key up to this row."""
        self._df = self._df.withColumn("_value", value)
        frame = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = self._df.withColumn(name, F.min("_value").over(frame))

        def before_run(one: Column, before) -> Column:
            return F.min(one).over(before.rowsBetween(Window.unboundedPreceding, -1))

        carried = self._carry(local, "_before", F.min("_value"), before_run)
        self._df = carried.withColumn(
            name, F.least(name, F.col("_before").cast(self._df.schema["_value"].dataType))
        ).drop("_before", "_value")
        return self

    def total(self, name: str, value: Column) -> Ordered:
        """Add the sum of `value` over all rows of the key to each of them."""
        local = self._df.withColumn(name, F.sum(value).over(Window.partitionBy(*self._groups)))
        if self._is_cut:
            # One row per cut key.
            whole = self._df.where("_split").groupBy(*self.keys).agg(F.sum(value).alias("_whole"))
            local = (
                null_safe_join(local, F.broadcast(whole), self.keys, "left")
                .withColumn(name, F.coalesce("_whole", name))
                .drop("_whole")
            )
        self._df = local
        return self

    def frame(self) -> DataFrame:
        return self._df.drop("_run", "_split")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key.

    Spark keeps at most `n` rows per key and task before the shuffle
    (WindowGroupLimit), so a hot key costs no more than any other. `n` stays
    small: the limit is not planned above 1,000.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") <= n)
        .drop("_place")
    )


def dense_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 1 in `order`, without gaps.

    The rows are dealt to ranges of `order`, sorted there and written once with their place
    in the range; the sizes of the ranges before shift the places. No task sees the whole table,
    and as many ranges are made as the session has shuffle partitions.
    """
    # The lower 33 bits of a monotonic id are the row's place in its partition.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_range"), place.alias("_place")),
        "numbered",
    )
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    # One row for each range.
    return ranged.join(F.broadcast(offsets), "_range").select(
        *df.columns, (F.col("_place") + F.col("_before") + 1).cast("long").alias(name)
    )
