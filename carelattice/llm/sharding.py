"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: it starts
at an offset and goes on by a step, both hashes of its name. Shards take turns; at its turn a
shard claims the first slot of its order that is free. All shards so own equally many slots, give
or take one, and a shard more or less changes few slots. A row's key hashes to a slot, the slot
names the shard: one broadcast lookup in constant time, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A shard's number takes two bytes of the table.
MOST_SHARDS = 0xFFFF
#: Preferences that a turn looks at before it looks at all that are left.
FIRST_LOOK = 32


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def hashed(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """slot, shard: the owner of each of the `slots` slots; `slots` rows, a prime number.

    `shards` are names; equal lists give equal tables, and a name's order of preference does not
    depend on the others. An empty list is refused, as no row could be placed.
    """
    if not shards or len(shards) > min(MOST_SHARDS, slots):
        raise ValueError("there must be a shard, and no more shards than slots")
    if len(set(shards)) != len(shards) or not _is_prime(slots):
        raise ValueError("shard names must differ and the number of slots must be prime")
    n = len(shards)
    named = F.array(*map(F.lit, shards))
    preferences = spark.range(1, numPartitions=1).select(
        F.transform(named, lambda s: hashed(F.concat(F.lit("offset-"), s)) % slots).alias("offsets"),
        F.transform(named, lambda s: hashed(F.concat(F.lit("step-"), s)) % (slots - 1) + 1).alias("steps"),
    )
    # The table is a binary of two bytes a slot, FFFF while the slot is free.
    slot = "cast((offsets[turn % {n}] + j * steps[turn % {n}]) % {slots} as int)".format(n=n, slots=slots)
    free = f"substring(state.owners, 2 * {slot} + 1, 2) = X'FFFF'"
    seen = f"state.seen[turn % {n}]"
    look = "get(filter(sequence({low}, {high}), j -> {free}), 0)"
    last = slots - 1
    first_free = (
        f"coalesce({look.format(low=seen, high=f'least({seen} + {FIRST_LOOK}L, {last}L)', free=free)},"
        f" {look.format(low=seen, high=f'{last}L', free=free)})"
    )
    owner = f"unhex(lpad(hex(turn % {n}), 4, '0'))"
    # A one-element transform names the preference found, so that it is looked for once.
    step = f"""transform(array({first_free}), j -> named_struct(
        'owners', overlay(state.owners placing {owner} from 2 * {slot} + 1 for 2),
        'seen', transform(state.seen, (x, k) -> if(k = turn % {n}, j + 1L, x))))[0]"""
    start = f"named_struct('owners', unhex(repeat('FFFF', {slots})), 'seen', array_repeat(0L, {n}))"
    filled = preferences.select(
        F.expr(
            f"aggregate(sequence(0, {slots - 1}), {start}, (state, turn) -> {step}, state -> state.owners)"
        ).alias("owners")
    )
    return filled.select(
        F.posexplode(
            F.expr(
                f"transform(sequence(0, {slots - 1}),"
                " s -> cast(conv(hex(substring(owners, 2 * s + 1, 2)), 16, 10) as int))"
            )
        ).alias("slot", "number")
    ).select("slot", named[F.col("number")].alias("shard"))


def place(docs: DataFrame, shards: list[str], slots: int, id_column: str = "doc_id") -> DataFrame:
    """doc_id, slot, shard of every row.

    The table is broadcast: `slots` rows, a number that the caller sets and that does not grow
    with the documents. Rows of one id share a shard; a hot source or text is spread by its ids.
    A missing id counts as the empty key. An empty table gives an empty result; other columns
    are not read.
    """
    table = lookup_table(docs.sparkSession, shards, slots)
    keyed = docs.select(
        F.col(id_column).alias("doc_id"),
        (hashed(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % slots).cast("int").alias("slot"),
    )
    return keyed.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")
