"""Bigram probabilities against their definition."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from styleops.operators.language_model import BigramModel

ROWS = [[1, 5, 6, 5, 6, 2], [1, 6, 2], [1, 5, 5, 5, 2], [7], []]


@pytest.fixture(scope="module")
def model(spark):
    return BigramModel(spark.createDataFrame([(r,) for r in ROWS], "ids array<int>"), "ids", 9)


def test_probabilities_of_each_context_sum_to_one(spark, model):
    every = spark.range(9).select(F.col("id").cast("int").alias("before")).crossJoin(spark.range(9).select(F.col("id").cast("int").alias("id")))
    sums = model.log_probabilities(every).groupBy("before").agg(F.sum(F.exp("log_p")).alias("p"))
    assert {r.before for r in sums.collect()} == set(range(9)) and all(r.p == pytest.approx(1) for r in sums.collect())


def test_perplexity_equals_the_definition(spark, model):
    seen = Counter(p for r in ROWS for p in zip(r, r[1:]))

    def probability(v, w):
        rest = 0.99 * sum(b == w for _, b in seen) / len(seen) + 0.01 / 9
        total, kinds = sum(n for (a, _), n in seen.items() if a == v), sum(a == v for a, _ in seen)
        return rest if not total else max(seen[v, w] - 0.75, 0) / total + 0.75 * kinds / total * rest

    rows = [("a", [1, 5, 6, 2]), ("a", [1, 8, 8]), ("b", [5, 5, 2]), ("b", [3])]
    got = model.perplexity(spark.createDataFrame(rows, "split string, ids array<int>"), "ids", ["split"])
    for r in got.collect():
        logs = [math.log(probability(*p)) for s, ids in rows if s == r.split for p in zip(ids, ids[1:])]
        assert r.tokens == len(logs) and r.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)))


def test_nothing_seen(spark):
    nothing = BigramModel(spark.createDataFrame([([],)], "ids array<int>"), "ids", 4)
    got = nothing.perplexity(spark.createDataFrame([([1, 2, 3],)], "ids array<int>"), "ids").first()
    assert got.tokens == 2 and got.perplexity == pytest.approx(4)
