"""Placement of rows into shards by a permutation-filled lookup table, in DataFrame operations only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, about a hundred times the number of shards: shares then differ by about a hundredth.
TABLE_SIZE = 4099
#: The table is broadcast, so its size is bounded.
LARGEST_TABLE = 1_000_003


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[str]:
    """The shard of each slot: shards take turns, each claiming the next free slot of its permutation.

    Shard ``s`` prefers the slots ``(offset + j * skip) mod size`` in the order of j; ``size`` must
    be prime, so that each such walk meets every slot.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not len(shards) <= size <= LARGEST_TABLE or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size must be a prime from the number of shards to {LARGEST_TABLE}")
    walk = [[_number(s, "offset") % size, _number(s, "skip") % (size - 1) + 1] for s in shards]
    slots: list[str | None] = [None] * size
    for turn in range(size):
        k = turn % len(shards)
        at, skip = walk[k]
        while slots[at] is not None:
            at = (at + skip) % size
        slots[at] = shards[k]
        walk[k][0] = (at + skip) % size
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 32 bits of the MD5 of its text, modulo ``size``; null as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(size))


def slot_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``slot, shard``: the lookup table as a DataFrame of ``size`` rows."""
    text = F.split(F.lit("\n".join(lookup_table(shards, size))), "\n")
    return spark.range(1).select(F.posexplode(text).alias("slot", "shard"))


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` (columns of these names are replaced).

    One broadcast join with ``size`` rows, no shuffle. Repeated rows and equal keys meet in one
    shard, null keys in the shard of the empty text; no other column is read.
    """
    keyed = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size).cast("int"))
    return keyed.join(F.broadcast(slot_table(rows.sparkSession, shards, size)), "slot")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder for each shard; a shard's rows are dealt over ``files_per_shard`` tasks."""
    deal = F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(files_per_shard))
    placed.repartition("shard", deal).write.partitionBy("shard").parquet(path)
