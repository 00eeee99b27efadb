"""Helpers of this package: written intermediate tables, fixed constants, batch sizes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from styleops.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows handed to Python at once; a batch of very long documents still fits beside the executor.
BATCH_ROWS = 500


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def narrow(df: DataFrame, share: int = 16) -> DataFrame:
    """``df`` in one file for ``share`` shuffle partitions, for rows far smaller than the text they come from."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, partitions(spark) // share))


def regrouped(df: DataFrame, share: int = 16) -> DataFrame:
    """As ``narrow``, by a shuffle of the few rows that a costly stage gives, so that the stage keeps its tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, partitions(spark) // share))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared scratch folder once and read it from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(docs: DataFrame, *left_out: str) -> Column:
    """The columns of ``docs`` as one struct with numbered fields, so that no name clashes."""
    return F.struct(F.lit(True).alias("here"), *[column(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in left_out])


def row_columns(docs: DataFrame, row: str, *left_out: str) -> list[Column]:
    """The columns that ``as_row`` put into ``row``."""
    return [F.col(f"{row}.c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in left_out]


def content_digest() -> Column:
    """The digest of a row's text, null as empty."""
    return F.unhex(F.sha2(whole_text(), 256))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the cheaper function."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows Spark hands to a Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pd.DataFrame], column: str, limit: int) -> Iterator[pd.DataFrame]:
    """Join batches until their texts reach ``limit`` characters."""
    held, size = [], 0
    for rows in batches:
        held.append(rows)
        size += int(rows[column].str.len().sum())
        if size >= limit:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def runs(batches: Iterator[pd.DataFrame], names: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The runs of rows that are equal in ``names``, of batches that are sorted by them."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        if held:
            rows = pd.concat([held.pop(), rows], ignore_index=True)
        change = np.zeros(len(rows) - 1, dtype=bool)
        for name in names:
            values = rows[name].to_numpy()
            change |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        yield from (rows.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        held = [rows.iloc[cuts[-1] :]]
    yield from held


def total_bytes(docs: DataFrame) -> int:
    """The size of all texts, read in one pass without a shuffle of rows."""
    return docs.agg(F.sum(F.octet_length(whole_text()).cast("long"))).first()[0] or 0


def blob(values, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def unblob(parts: Sequence[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=kind)


def steps_blob(values) -> bytes:
    """64-bit numbers as the differences of neighbours, first all lowest bytes, then all second ones, and so on.

    Numbers that rise slowly then are mostly zero bytes in a row, which the shuffle's compression takes away.
    """
    steps = np.diff(np.asarray(values, dtype="<i8"), prepend=np.int64(0))
    return np.ascontiguousarray(steps.view("u1").reshape(-1, 8).T).tobytes()


def steps_unblob(parts: Sequence[bytes]) -> np.ndarray:
    made = [np.cumsum(np.ascontiguousarray(np.frombuffer(p, "u1").reshape(8, -1).T).view("<i8").ravel()) for p in parts]
    return np.concatenate(made) if made else np.zeros(0, np.int64)
