"""Batches against a single pass, nearest rows against a full product."""

import random

import numpy as np
import pytest

from styleops.operators import batching, vectors


def single_pass(samples, max_tokens, max_size):
    out, batch, size, src, tgt = [], 0, 0, 0, 0
    for key, a, b in sorted(samples):
        if size and (size == max_size or (max(src, a) + max(tgt, b)) * (size + 1) > max_tokens):
            batch, size, src, tgt = batch + 1, 0, 0, 0
        if not size and a + b > max_tokens:
            out.append((-1, -1, key))
        else:
            out.append((batch, size, key))
            size, src, tgt = size + 1, max(src, a), max(tgt, b)
    return sorted(out)


@pytest.mark.parametrize(("n", "max_tokens", "max_size", "block"), [(0, 50, 5, 5), (1, 50, 5, 8), (700, 60, 7, 7), (1500, 300, 16, 20), (900, 40, 128, 128)])
def test_one_greedy_pass(spark, monkeypatch, n, max_tokens, max_size, block):
    monkeypatch.setattr(batching, "FAN", 3)  # several levels of maps
    rng = random.Random(n)
    samples = [(7 * k + rng.randrange(7), rng.choice([1, 2, 3, 9, 30]), rng.choice([1, 2, 5, 35])) for k in range(n)]
    rows = spark.createDataFrame(samples, "pair_id long, src_len int, tgt_len int").repartition(5)
    got = batching.pack_batches(rows, max_tokens, max_size, block).collect()
    assert sorted(tuple(r) for r in got) == single_pass(samples, max_tokens, max_size)


def test_runs_of_oversize_samples(spark):
    samples = [(k, 100 if 20 <= k < 400 or k in (0, 599) else 3, 2) for k in range(600)]
    rows = spark.createDataFrame(samples, "pair_id long, src_len int, tgt_len int")
    got = batching.pack_batches(rows, 40, 6, 10).collect()
    assert sorted(tuple(r) for r in got) == single_pass(samples, 40, 6)


@pytest.mark.parametrize(("query_group", "row_group", "k"), [(4000, 50000, 5), (7, 11, 3), (3, 40, 200)])
def test_nearest_equals_a_full_product(spark, query_group, row_group, k):
    rng = np.random.default_rng(4)
    rows = np.round(rng.normal(size=(150, 6)), 1)
    rows[40:60] = rows[39]  # equal scores are put in order by id
    asked = np.round(rng.normal(size=(23, 6)), 1)
    table = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(rows)), (900, None)], "id long, vec array<double>")
    queries = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(asked)), (901, None)], "id long, vec array<double>")
    got = {(r.query, r.place): r.id for r in vectors.nearest(table, queries, k, query_group, row_group).collect()}
    scores = np.round(asked @ rows.T, 9)
    want = {}
    for q in range(len(asked)):
        for place, i in enumerate(sorted(range(len(rows)), key=lambda i: (-scores[q, i], i))[:k]):
            want[q, place + 1] = i
    assert got == want
    assert vectors.nearest(table, queries.limit(0), k).count() == 0 and vectors.nearest(table.limit(0), queries, k).count() == 0


def test_nearest_of_asked_words(spark):
    table = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [2.0, 0.1]), (2, "c", [0.0, 3.0])], "id long, word string, vec array<double>")
    got = vectors.nearest_words(table, spark.createDataFrame([("b",), ("absent",)], "word string"), 2).orderBy("place").collect()
    assert [(r.word, r.near) for r in got] == [("b", "b"), ("b", "a")]
