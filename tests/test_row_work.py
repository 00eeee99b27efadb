"""Work that is done once for each text, and the noise of a row in one go."""

import pytest
from pyspark.sql import functions as F

from styleops.functions import noise, text
from styleops.operators import bpe
from styleops.operators import language_model as LM
from styleops.operators.metrics.bleu import bleu_stats
from styleops.operators.metrics.meteor import meteor_exact
from styleops.plans import model_queries as M


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_13a_are_followed_once(spark):
    df = spark.createDataFrame([("a-b, c.",), (None,)], "txt string")
    out = df.select(text.tokenize_13a(F.upper("txt")).alias("x"))
    assert plan_of(out).count("regexp_replace(") == len(text.RULES_13A)
    assert [r.x for r in out.collect()] == ["A-B , C .", None]


def test_metrics_split_texts_in_rows_only(spark):
    pairs = spark.createDataFrame([(1, "a b c", ["a b", None]), (1, None, ["a b c d"]), (2, "x", None), (None, "a b", ["a b"])], "pair_id long, hyp string, refs array<string>")
    assert "split(" not in plan_of(bleu_stats(pairs)) and "split(" not in plan_of(meteor_exact(pairs))
    got = sorted(map(str, bleu_stats(pairs).select("pair_id", "testlen", "reflen", "correct_1", "correct_2").collect()))
    want = [(1, 3, None, 3, 2), (1, None, 4.0, 3, 2), (2, 1, None, 0, 0), (None, 2, 2.0, 0, 0)]
    assert got == sorted(f"Row(pair_id={a}, testlen={b}, reflen={c}, correct_1={d}, correct_2={e})" for a, b, c, d, e in want)


def test_pieces_are_joined_without_a_split(spark):
    df = spark.createDataFrame([("▁a b　▁c \td",), ("",), (None,)], "txt string")
    out = df.select(bpe.bpe_decode(F.col("txt")).alias("x"))
    assert "split(" not in plan_of(out) and [r.x for r in out.collect()] == ["ab cd", "", None]


def test_bigrams_are_counted_once(spark, sf, monkeypatch):
    calls = []
    counted = LM.bigram_counts
    monkeypatch.setattr(LM, "bigram_counts", lambda *a: calls.append(a) or counted(*a))
    assert M.QUERIES["perplexity_bigram"](spark, sf).count() == 3 and len(calls) == 1


def test_only_markers_are_drawn_for(spark):
    df = spark.createDataFrame([(1, [1, 3, 3, 7, 2])], "id long, ids array<int>")
    plan = plan_of(df.select(noise.duplicate_markers(F.col("ids"), F.col("id"), 0.5)))
    assert plan.index("= 3)") < plan.index("md5(")


@pytest.mark.parametrize("seed", [0, 5])
def test_noise_of_a_row_in_one_go(spark, seed):
    rows = [(k if k % 9 else None, [(k * j * 7) % 11 if (k + j) % 13 else None for j in range(1, 1 + k % 17)]) for k in range(200)]
    df = spark.createDataFrame([*rows, (3, None)], "id long, ids array<int>")
    ids, key = F.col("ids"), F.col("id")
    steps = noise.word_substitute(noise.word_blank(noise.word_drop(ids, key, 0.2, seed), key, 0.1, seed), key, 0.3, 40, seed)
    steps = noise.marker_shuffle(noise.duplicate_markers(steps, key, 0.4, seed=seed), key, 3, seed=seed)
    steps = noise.word_shuffle(noise.insert_tags(steps, key, 0.4, seed=seed), key, 2, seed)
    whole = noise.noise_pipeline(ids, key, 40, 0.2, 0.1, 0.3, 2, 0.4, 1.0, seed=seed)
    out = df.select(steps.alias("a"), whole.alias("b"))
    assert "md5(" not in plan_of(df.select(whole)) and all(r.a == r.b for r in out.collect())
