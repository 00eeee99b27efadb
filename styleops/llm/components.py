"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleops.llm.common import narrow
from styleops.llm.common import written as written_whole


def written(df: DataFrame, name: str) -> DataFrame:
    return written_whole(narrow(df), name)


def _mins(edges: DataFrame, name: str) -> DataFrame:
    """The smallest node among each ``u`` and its neighbours, written so that a hub's join can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return written(least.select(F.col("u").alias("node"), F.least("u", "m").alias("m")), name)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the pairs ``u, v``; a component is named by its smallest node.

    Edges are only ever replaced by others of the same component, until each node points to the
    smallest one. Each round is written; nothing is gathered on the driver but a count and a checksum.
    Nodes may be of any type with an order; null nodes and loops are left out.
    """
    names = edges.columns[:2]
    a, b = F.col(names[0]), F.col(names[1])
    edges = edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_mins(both, "large-star"), F.col("u") == F.col("node")).filter(F.col("v") > F.col("u"))
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-edges")
        small = large.join(_mins(large, "small-star"), F.col("u") == F.col("node"))
        down = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = written(
            down.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "edges"
        )
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
