"""Explode token arrays into n-gram rows with generated code only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window(width: int) -> list[str]:
    """The names of the words of a window."""
    return [f"w{d}" for d in range(width)]


def explode_windows(rows: DataFrame, keep: list[str], tokens: Column, width: int) -> DataFrame:
    """One row for each token: ``keep``, position ``i`` and the words ``w0 .. w{width-1}`` from there.

    The array is zipped with its own successors, so an exploded row carries a few words and never
    the whole array. Words past the end are null.
    """
    names = window(width)
    shifted = [F.slice("_toks", d + 1, F.size("_toks")).alias(n) for d, n in enumerate(names)]
    return (
        rows.select(*keep, tokens.alias("_toks"))
        .select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("i", "_w"))
        .select(*keep, "i", *[F.col(f"_w.{n}").alias(n) for n in names])
    )


def explode_ngrams(rows: DataFrame, keep: list[str], tokens: Column, low: int, high: int) -> DataFrame:
    """One row for each n-gram: ``keep``, ``n``, ``gram``."""
    sized = [
        F.when(
            F.col(f"w{n - 1}").isNotNull(),
            F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *window(n)).alias("gram")),
        )
        for n in range(low, high + 1)
    ]
    at = explode_windows(rows, keep, tokens, high)
    return (
        at.select(*keep, F.explode(F.array(*sized)).alias("_g"))
        .filter(F.col("_g").isNotNull())
        .select(*keep, "_g.n", "_g.gram")
    )
