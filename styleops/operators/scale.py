"""Building blocks that keep wide steps distributed: global numbering and skew-proof lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from styleops.session import checkpointed

# About a hundred megabytes of narrow rows (a phrase or word and a number or two).
BROADCAST_ROWS = 1_000_000
HEAVY_KEYS = 10_000
#: Bits of a key filter for each key, and at most (four megabytes).
FILTER_BITS_PER_KEY = 8
FILTER_BITS = 1 << 25


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df``, which should be written already, has at most ``rows`` rows."""
    return df.count() <= rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Lay rows out by key over all shuffle partitions.

    The number is given, so that adaptive execution does not merge partitions whose rows are about
    to be exploded into many more.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


def repeated(df: DataFrame, key: str) -> bool:
    """True when a key comes more than once; reads and shuffles keys only."""
    return not df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def ordered_index(
    df: DataFrame,
    order: Sequence[Column],
    name: str,
    group: Sequence[str] = (),
    start: int = 0,
) -> DataFrame:
    """Number the rows of each group along ``order`` without gathering a group in one task.

    Rows are range-partitioned by (group, order), so partition p holds only rows before those of
    p+1. A row's number is its place among its group's rows in its own partition plus the group's
    row count in earlier partitions. ``order`` has to be a total order.
    """
    group = list(group)
    keys = [F.col(g) for g in group] + list(order)
    placed = checkpointed(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    counts = placed.groupBy("_slot", *group).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    before = W.partitionBy(*group).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    # one row for each (partition, group) that meet: at most partitions + groups rows
    offsets = checkpointed(
        counts.select(
            F.col("_slot").alias("_in"),
            *[F.col(g).alias(f"_of_{g}") for g in group],
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        )
    )
    small = F.broadcast(offsets) if bounded(offsets) else offsets
    match = F.col("_slot") == F.col("_in")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    number = F.col("_place") + F.col("_shift") + F.lit(start)
    return placed.join(small, match).select(*df.columns, number.alias(name))


def small_join(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table that is expected to be small: broadcast only after counting its rows."""
    table = checkpointed(table)
    return rows.join(F.broadcast(table) if bounded(table) else table, list(on), how)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    weight: str,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``rows`` to a keyed ``table`` whose ``weight`` tells how often each key occurs in rows.

    ``table`` should be written already (checkpoint or table), because it is read more than once.

    A table of at most ``broadcast_rows`` rows is broadcast (pass fewer for wide rows). Otherwise
    keys with at least one part in ``HEAVY_KEYS`` of the total weight - no more than ``HEAVY_KEYS``
    of them can exist - are broadcast, and only the light keys go through a shuffle join, where none can dominate.
    """
    on = list(on)
    if bounded(table, broadcast_rows):
        return rows.join(F.broadcast(table.drop(weight)), on, how)
    total = table.agg(F.sum(weight)).first()[0]
    heavy = F.col(weight) * HEAVY_KEYS >= F.lit(total)
    head = F.broadcast(table.filter(heavy).drop(weight))
    tail = table.filter(~heavy).drop(weight)
    return rows.join(head, on, "inner").unionByName(
        rows.join(head.select(*on), on, "left_anti").join(tail, on, how)
    )


def most_common(table: DataFrame, n: int, weight: str) -> Column:
    """True for rows of so high a ``weight``, a count, that at most ``n`` have it."""
    seen, least = 0, None
    # counts sum up to the rows counted, so there are few different ones
    for r in table.groupBy(weight).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc(weight)).collect():
        if (seen := seen + r["_n"]) > n:
            break
        least = r[weight]
    return F.lit(False) if least is None else F.col(weight) >= least


def _places(keys: Sequence[Column], bits: int) -> list[Column]:
    digest = F.xxhash64(*keys)
    return [digest.bitwiseAND(bits - 1), F.shiftrightunsigned(digest, 32).bitwiseAND(bits - 1)]


def key_filter(table: DataFrame, keys: Sequence[str], most_bits: int = FILTER_BITS) -> Callable[..., Column]:
    """A function of key columns that is false for most keys that ``table`` has not, and never for one it has.

    The filter is a field of bits, two for each key, of bounded size whatever the size of the table; it travels with the plan as a
    constant, so rows are dropped where they are made, before any shuffle.
    """
    n = table.count()
    bits = 64
    while bits < min(FILTER_BITS_PER_KEY * n, most_bits):
        bits *= 2
    place = F.explode(F.array(*_places([F.col(k) for k in keys], bits)))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    found = table.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), one.alias("bit"))
    words = ["0"] * (bits // 64)
    for row in found.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most ``bits / 64`` rows
        words[row["word"]] = str(row["bits"])
    field = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")

    def may_have(*columns: Column) -> Column:
        tests = []
        for at in _places(columns, bits):
            word = F.get(field, F.shiftright(at, 6).cast("int"))
            tests.append(F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
        return tests[0] & tests[1]

    return may_have
