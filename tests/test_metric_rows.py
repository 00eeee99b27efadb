"""Metrics count inside the row of a pair: no exploded n-gram or vector is shuffled, sorted or kept."""

import re

import pytest

from styleops.operators.metrics.bleu import bleu_stats
from styleops.operators.metrics.cider import cider
from styleops.operators.metrics.counts import by_pair, metric_ngrams
from styleops.operators.metrics.embedding import embedding_scores

SCHEMA = "pair_id long, hyp string, refs array<string>"
ROWS = [
    (1, "a b c a b c d", ["a b c d", "a b a b c e"]),
    (2, "x y z x", ["x y", "z x y z"]),
    (2, "x y z q", ["x y z", None, "q q"]),
    (None, "a b", ["a b"]),
    (3, None, ["a b c"]),
    (4, "a b", None),
    (5, "a　b c", []),
]
VECTORS = [("a", [1.0, 2.0], 9), ("b", [0.0, -1.0], 8), ("c", None, 7), ("x", [0.5, 0.1], 6), ("z", [-3.0, 1.0], 2), ("q", [1.0, 1.0], 1)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "word string, vec array<double>, cnt long")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exact(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_matches_need_only_the_layout_by_pair(pairs):
    plan = plan_of(bleu_stats(pairs))
    assert plan.count("Exchange") == 1 and "Join" not in plan and "gram" not in plan


def test_grams_are_not_aggregated_by_spark(pairs):
    assert not re.search(r"Aggregate\(keys=\[[^\]]*gram", plan_of(metric_ngrams(by_pair(pairs))))


def test_rows_of_one_id_count_together(pairs):
    got = [tuple(r) for r in metric_ngrams(by_pair(pairs), 1).filter("pair_id = 2").select("ref_no", "gram", "cnt").collect()]
    assert sorted(got) == sorted([(-1, "x", 3), (-1, "y", 2), (-1, "z", 2), (-1, "q", 1), (0, "x", 2), (0, "y", 2), (0, "z", 1), (1, "x", 1), (1, "y", 1), (1, "z", 2), (2, "q", 2)])
    assert [r.correct_1 for r in bleu_stats(pairs).filter("pair_id = 2").collect()] == [7, 7]
    assert [r.correct_1 for r in bleu_stats(pairs).filter("pair_id IS NULL").collect()] == [0]


def test_vectors_travel_apart_from_the_pairs(pairs, vectors):
    plan = plan_of(embedding_scores(pairs, vectors))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_rare_words_score_alike(pairs, vectors):
    want = exact(embedding_scores(pairs, vectors))
    assert len(want) == len(ROWS) and all(exact(embedding_scores(pairs, vectors, wide_rows=n)) == want for n in (1, 4))


def test_cider_with_few_frequencies_at_hand(pairs):
    want = exact(cider(pairs))
    assert len(want) == len(ROWS) and any(r[1] > 0 for r in want)
    assert all(exact(cider(pairs, n)) == want for n in (0, 3))


def test_cider_joins_no_grams(pairs):
    plan = plan_of(cider(pairs))
    assert "Join" not in plan and not re.search(r"\bgram#", plan)


def test_questions_and_answers_of_blocks():
    """Numbers come back as they were packed, and blocks that share n-grams get their common frequencies."""
    import numpy as np
    import pyarrow as pa

    from styleops.operators.metrics import cider as CI

    numbers = np.array([0, 1, 255, 2**40, 2**64 - 1], np.uint64)
    assert CI._unpacked(CI._packed(numbers), np.uint64).tolist() == numbers.tolist() and len(CI._unpacked(b"", np.uint32)) == 0
    grams = [np.array(x, np.uint64) for x in ([3, 7, 2**63], [7, 9])]
    rows = [(0, block, CI._packed(np.diff(g, prepend=np.uint64(0))), CI._packed(np.arange(1, len(g) + 1, dtype=np.uint32))) for block, g in enumerate(grams)]
    got = CI._answers(pa.table(dict(zip(("part", "block", "grams", "df"), map(list, zip(*rows))))))
    assert [CI._unpacked(x, np.uint32).tolist() for x in got.column("df").to_pylist()] == [[1, 3, 3], [3, 2]]
    cuts = CI._cuts(np.array([5, 2**62, 2**63, 2**64 - 1], np.uint64), 4)
    assert cuts.tolist() == [0, 1, 2, 3, 4]
