"""Keyed uniform draws: the same key gives the same number in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(*key) -> Column:
    """A number in [0, 1) that depends only on the key parts."""
    parts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in key]
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)
