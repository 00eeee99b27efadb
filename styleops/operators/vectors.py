"""Unit vectors and nearest rows by dot product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from styleops.functions.text import let
from styleops.session import checkpointed

#: Vectors of one group of queries and of one group of rows; a task meets one of each.
QUERY_GROUP = 4_000
ROW_GROUP = 50_000
#: Rows multiplied at once.
PRODUCT = 2_000


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(vec: Column) -> Column:
    return let(
        vec.cast("array<double>"),
        lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))),
    )


class Best:
    """The k best rows of each query, by falling score (to nine digits) and then by id; two of them merge into one."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, id: np.ndarray, score: np.ndarray) -> None:
        query, id, score = (np.concatenate(x) for x in ((self.query, query), (self.id, id), (self.score, score)))
        order = np.lexsort((id, -np.round(score, 9), query))
        query = query[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        best = order[place < self.k]
        self.query, self.id, self.score = query[place < self.k], id[best], score[best]

    def add_product(self, query: np.ndarray, matrix: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """All rows as good as a query's k-th one of this product are merged in, so equals are put in order by id."""
        scores = matrix @ rows.T
        rounded = np.round(scores, 9)
        if len(ids) > self.k:
            least = np.partition(rounded, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            q, r = np.nonzero(rounded >= least[:, None])
        else:
            q, r = (x.ravel() for x in np.indices(scores.shape))
        self.add(query[q], ids[r], scores[q, r])


def _met(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        best = Best(k)
        if len(rows) and len(queries):
            matrix, numbers = np.stack(queries["asked"].to_numpy()), queries["query"].to_numpy(np.int64)
            for at in range(0, len(rows), PRODUCT):
                part = rows.iloc[at : at + PRODUCT]
                best.add_product(numbers, matrix, part["id"].to_numpy(np.int64), np.stack(part["vec"].to_numpy()))
        return pd.DataFrame({"query": best.query, "id": best.id, "score": best.score})

    return run


def nearest(table: DataFrame, queries: DataFrame, k: int, query_group: int = QUERY_GROUP, row_group: int = ROW_GROUP) -> DataFrame:
    """``query, id, score, place``: the k rows of ``table`` (id, vec) with the largest dot product; null vectors are left out.

    Queries and rows are dealt into groups of bounded size by a hash of their ids. A task meets one group of queries with one
    group of rows and hands on its k best rows for each query; the k best of all groups are then picked in partial
    steps. Nothing is collected; with more queries or more rows there are more tasks of the same size.
    """
    rows = table.select("id", F.col("vec").cast("array<double>").alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    asked = queries.select(F.col("id").alias("query"), F.col("vec").cast("array<double>").alias("asked"))
    asked = checkpointed(asked.filter("query IS NOT NULL AND asked IS NOT NULL"))
    n, cores = rows.count(), table.sparkSession.sparkContext.defaultParallelism
    across, down = -(-asked.count() // query_group) or 1, max(-(-n // row_group), min(cores, -(-n // PRODUCT)), 1)
    rows_met = rows.withColumns(
        {"q": F.explode(F.sequence(F.lit(0), F.lit(across - 1))), "r": F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")}
    )
    # columns of their own names: both tables may come from one
    queries_met = asked.withColumns(
        {"q": F.pmod(F.xxhash64("query"), F.lit(across)).cast("int"), "r": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))}
    )
    found = rows_met.groupBy("q", "r").cogroup(queries_met.groupBy("q", "r")).applyInPandas(_met(k), "query long, id long, score double")
    order = W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def nearest_sentences(table: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Nearest rows of ``table`` (id, vec) for each query, which is scaled to unit length first."""
    return nearest(table, queries.withColumn("vec", l2_normalize(F.col("vec"))), k)


def nearest_words(table: DataFrame, words: DataFrame, k: int = 10) -> DataFrame:
    """Nearest words of ``table`` (id, word, vec) for each asked word of ``words`` (word)."""
    unit = table.withColumn("vec", l2_normalize(F.col("vec")))
    names = table.select("id", "word")
    found = nearest(unit, unit.join(words, "word", "left_semi"), k)
    return (
        found.join(names, "id")
        .withColumnRenamed("word", "near")
        .join(names.select(F.col("id").alias("query"), "word"), "query")
        .select("word", "near", "score", "place")
    )
