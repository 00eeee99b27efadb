"""Group encoded samples into batches and pad them."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from styleops.functions.draws import hash_uniform
from styleops.operators import scale
from styleops.operators.vocab import PAD
from styleops.session import checkpointed

BATCH = ["batch_no"]
#: Samples of one block, and blocks whose maps are composed in one task.
BLOCK = 8192
FAN = 512
MAP = "parent long, node long, leave array<long>, made array<long>"


def length_buckets(rows: DataFrame, key: str, length: str, batch_size: int = 128) -> DataFrame:
    """``batch``: sentences of one length are dealt in turn over floor(n / size) + 1 batches.

    Numbering is distributed, so one length may hold any share of the rows.
    """
    placed = scale.ordered_index(rows, [F.col(key)], "at", [length])
    sizes = placed.groupBy(length).agg(
        (F.floor(F.count(F.lit(1)) / batch_size) + 1).alias("n_batches")
    )
    return scale.small_join(placed, sizes, [length]).withColumn(
        "batch", F.col("at") % F.col("n_batches")
    ).drop("at", "n_batches")


def next_starts(src: np.ndarray, tgt: np.ndarray, max_tokens: int, max_size: int) -> np.ndarray:
    """For each sample, where the batch that starts with it ends; a sample too large for any batch is a step of its own.

    A later start never ends earlier, so one pass with falling maxima of the open batch is enough.
    """
    n, at = len(src), 0
    out = np.empty(n, np.int64)
    a, b = src.tolist(), tgt.tolist()
    high_a: deque[int] = deque()
    high_b: deque[int] = deque()
    for start in range(n):
        if at <= start:
            at = start
            high_a.clear()
            high_b.clear()
        while at < n and at - start < max_size:
            wide = max(a[at], a[high_a[0]] if high_a else 0) + max(b[at], b[high_b[0]] if high_b else 0)
            if wide * (at - start + 1) > max_tokens:
                break
            for values, high in ((a, high_a), (b, high_b)):
                while high and values[high[-1]] <= values[at]:
                    high.pop()
                high.append(at)
            at += 1
        out[start] = max(at, start + 1)
        for high in (high_a, high_b):
            if high and high[0] == start:
                high.popleft()
    return out


def _through(steps: np.ndarray, fits: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first ``span`` places of a block, the place in the next block where the chain of batches from it goes on,
    and the batches on the way."""
    leave, made = np.empty(length, np.int64), np.empty(length, np.int64)
    for k in range(length - 1, -1, -1):
        to = int(steps[k])
        one = int(fits[k])
        leave[k], made[k] = (to - length, one) if to >= length else (leave[to], made[to] + one)
    return leave[:span], made[:span]


def _block_map(max_tokens: int, max_size: int, block: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        src, tgt = rows["src_len"].to_numpy(), rows["tgt_len"].to_numpy()
        own = int((rows["at"] // block == key[0]).sum())
        steps = next_starts(src, tgt, max_tokens, max_size)
        leave, made = _through(steps, src + tgt <= max_tokens, own, max_size)
        return pd.DataFrame([(key[0] // FAN, key[0], leave.tolist(), made.tolist())], columns=["parent", "node", "leave", "made"])

    return run


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """The maps of neighbouring nodes as one; a block that is shorter than a batch can only be the last one."""
    rows = rows.sort_values("node")
    leave, made = None, None
    for to, more in zip(rows["leave"], rows["made"], strict=True):
        to, more = np.asarray(to), np.asarray(more)
        if leave is None:
            leave, made = to, more
        else:
            inside = np.minimum(leave, len(to) - 1)
            past = leave >= len(to)
            made = made + np.where(past, 0, more[inside])
            leave = np.where(past, leave - len(to), to[inside])
    node = int(rows["parent"].iloc[0])
    return pd.DataFrame([(node // FAN, node, leave.tolist(), made.tolist())], columns=["parent", "node", "leave", "made"])


def _entered(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """Where the chain enters each child of a node, and the batches before it."""
    out = []
    if len(entry):
        at, before = int(entry["entry"].iloc[0]), int(entry["before"].iloc[0])
        for node, leave, made in rows.sort_values("node")[["node", "leave", "made"]].itertuples(index=False):
            out.append((node, at, before))
            if at < len(leave):
                at, before = int(leave[at]), before + int(made[at])
            else:
                at -= len(leave)
    return pd.DataFrame(out, columns=["node", "entry", "before"])


def _assigned(max_tokens: int, max_size: int, block: int):
    def run(key: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        src, tgt = rows["src_len"].to_numpy(), rows["tgt_len"].to_numpy()
        own = int((rows["at"] // block == key[0]).sum())
        steps, fits = next_starts(src, tgt, max_tokens, max_size), src + tgt <= max_tokens
        batch, pos = np.full(len(rows), -2, np.int64), np.full(len(rows), -1, np.int64)
        at, number = int(entry["entry"].iloc[0]), int(entry["before"].iloc[0])
        while at < own:
            to = int(steps[at])
            if fits[at]:
                batch[at:to], pos[at:to] = number, np.arange(to - at)
                number += 1
            else:
                batch[at:to] = -1
            at = to
        out = pd.DataFrame({"batch_no": batch, "pos": pos, "pair_id": rows["pair_id"]})
        return out[batch > -2]

    return run


def pack_batches(samples: DataFrame, max_tokens: int = 8000, max_size: int = 128, block: int = BLOCK) -> DataFrame:
    """``batch_no, pos, pair_id`` for samples ``pair_id, src_len, tgt_len``: one greedy pass in key order over the whole table.

    A batch grows while its size and its padded token count stay in bounds. A sample too large for a batch of its own
    closes the open batch and gets batch number -1.

    The pass runs in many tasks. Samples are numbered by key and cut into blocks. Where a batch ends depends on its first sample
    only, so a block (with the first samples of the next one) tells for each place where the chain of batches may
    enter it where the chain goes on. These small maps are composed in groups of ``FAN``, level by level, down to one; the way
    back gives each block its entry and its first batch number, and the blocks then number their batches.
    """
    if block < max_size:
        raise ValueError("a block has to hold the largest batch")
    spark = samples.sparkSession
    placed = scale.ordered_index(samples.select("pair_id", "src_len", "tgt_len"), [F.col("pair_id")], "at")
    here = F.floor(F.col("at") / block)
    both = F.when((F.col("at") % block < max_size) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))
    blocks = checkpointed(placed.withColumn("node", F.explode(both)).repartition("node"))
    one = blocks.groupBy("node")
    levels = [checkpointed(one.applyInPandas(_block_map(max_tokens, max_size, block), MAP))]
    nodes = -(-placed.count() // block)
    while nodes > 1:
        levels.append(checkpointed(levels[-1].groupBy("parent").applyInPandas(_composed, MAP)))
        nodes = -(-nodes // FAN)
    entry = spark.range(1).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("before"))
    for level in reversed(levels[:-1]):
        found = level.groupBy("parent").cogroup(entry.withColumnRenamed("node", "parent").groupBy("parent"))
        entry = checkpointed(found.applyInPandas(_entered, "node long, entry long, before long"))
    return one.cogroup(entry.groupBy("node")).applyInPandas(_assigned(max_tokens, max_size, block), "batch_no long, pos int, pair_id long")


def shuffle_samples(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``at``: place of each row in a random order that depends on the seed only."""
    drawn = rows.withColumn("u", hash_uniform(F.col(key), "order", seed))
    return scale.ordered_index(drawn, [F.col("u"), F.col(key)], "at").drop("u")


def pad_batch(batches: DataFrame, ids: str, group: list[str] = BATCH) -> DataFrame:
    """Right-pad ``ids`` to the longest row of its batch; adds the length before padding."""
    longest = F.max(F.size(ids)).over(W.partitionBy(*group))
    return (
        batches.withColumn("_max", longest)
        .withColumn("length", F.size(ids))
        .withColumn(ids, F.concat(ids, F.array_repeat(F.lit(PAD), F.col("_max") - F.size(ids))))
        .drop("_max")
    )


def pad_mask(padded: Column, length: Column, strict: bool = True) -> Column:
    """True at masked places: past the length, or from the length on if not ``strict``."""
    return F.transform(padded, lambda _, i: (i > length) if strict else (i >= length))
