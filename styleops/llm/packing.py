"""Packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleops.llm.chunks import encode_texts
from styleops.llm.common import small_batches, whole_text

CAPACITY = 2048
END_ID = 1
#: Documents of one packing shard; the number of shards grows with the table.
SHARD_DOCS = 16_384
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens``: each document's ids and the end id, cut at multiples of ``capacity``.

    ``ids`` holds little-endian unsigned 32-bit numbers. A null or empty text is the end id alone.
    """
    small_batches(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = 4 * capacity
        for rows in batches:
            out = []
            for doc, ids in zip(rows["doc_id"].tolist(), encode_texts(path, rows["norm"].tolist()), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    out.append((None if doc != doc else doc, at // 4, len(part) // 4, part, len(ids) // 4))
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens"])
            yield made.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("norm")).mapInPandas(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each item, and the number of windows; items come online, in the given order.

    ``open_at[h]`` counts the windows filled to level h. An item goes to the level (0: a new window)
    that makes the sum of the squared counts smallest, to the fullest such level on a tie. When all
    items are placed, windows that are still partly filled are laid onto each other, fullest first,
    each onto the fullest one that has room.
    """
    open_at = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    window, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        level = 0
        if size < capacity:
            room = capacity - size
            here = open_at[1 : room + 1]
            cost = np.where(here > 0, 2 + 2 * (open_at[1 + size : capacity + 1] - here), np.iinfo(np.int64).max)
            if here[-1] > 0:
                cost[-1] -= 1
            best = room - 1 - int(np.argmin(cost[::-1]))
            if cost[best] <= 2 * open_at[size] + 1:
                level = best + 1
        if level:
            at = stacks[level].pop()
            open_at[level] -= 1
        else:
            at, made = made, made + 1
        window[k], offset[k] = at, level
        if level + size < capacity:
            open_at[level + size] += 1
            stacks[level + size].append(at)
    onto, shift = np.arange(made), np.zeros(made, np.int64)
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    for fill in range(capacity - 1, 0, -1):
        for at in stacks[fill]:
            fit = next((h for h in range(capacity - fill, 0, -1) if levels[h]), 0)
            base = levels[fit].pop() if fit else at
            onto[at], shift[at] = base, fit
            levels[fit + fill].append(base)
    names = np.unique(onto)
    return np.searchsorted(names, onto[window]), offset + shift[window], len(names)


def pack(parts: DataFrame, documents: int, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (``doc_id, start, length`` and any more) with ``sequence_id`` and ``offset``.

    Parts are dealt to shards by a hash of all their columns, so equal ids and null ids spread; a
    shard holds about ``SHARD_DOCS`` documents whatever the size of the table, and packs its parts
    in the order of (doc_id, start). A lost task is repeated with the same result.
    """
    shards = max(1, -(-documents // SHARD_DOCS))
    names = parts.columns
    dealt = parts.withColumn("_shard", F.pmod(F.xxhash64(*names), F.lit(shards)))
    fields = parts.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "length"], kind="stable", ignore_index=True)
        at, offset, _ = sum_of_squares(rows["length"].to_numpy(np.int64), capacity)
        rows["sequence_id"], rows["offset"] = at + (int(key[0]) << 32), offset
        return rows.drop(columns="_shard")

    return dealt.groupBy("_shard").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs`` with its place; of the ids only their CRC-32 is carried through the shuffle."""
    parts = pieces(docs, path, capacity).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(parts, docs.count(), capacity)


def sequences(placed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids``: placed pieces with ``ids`` joined in order; a sequence is padded to ``capacity`` unless its length is a power of two."""
    fill = np.full(capacity, pad_id, dtype="<u4").tobytes()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(rows.sort_values("offset")["ids"])
        n = len(ids) // 4
        return pd.DataFrame({"sequence_id": rows["sequence_id"][:1], "ids": [ids if n & (n - 1) == 0 else ids + fill[len(ids) :]]})

    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids binary")
