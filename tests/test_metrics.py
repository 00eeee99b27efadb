import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from styleops.operators.metrics import report
from styleops.operators.metrics.bleu import bleu_stats, multi_bleu, reference_length
from styleops.operators.metrics.cider import cider, cider_df
from styleops.operators.metrics.embedding import best_matches
from styleops.operators.metrics.rouge import common_length
from styleops.plans import views as V

SCHEMA = "pair_id long, hyp string, refs array<string>"
# The sentences and scores of the published examples, here and in the tests of single pairs.
CORPUS = [
    (
        0,
        "this is the model generated sentence1 which seems good enough",
        [
            "this is one reference sentence for sentence1",
            "this is one more reference sentence for sentence1",
        ],
    ),
    (
        1,
        "this is sentence2 which has been generated by your model",
        [
            "this is a reference sentence for sentence2 which was generated by your model",
            "this is the second reference sentence for sentence2",
        ],
    ),
]


def individual(spark, hyp, refs, **options):
    pairs = spark.createDataFrame([(0, hyp, refs)], SCHEMA)
    return report.compute_individual_metrics(pairs, **options).first().asDict()


def test_corpus_values(spark):
    rows = report.compute_metrics(spark.createDataFrame(CORPUS, SCHEMA)).collect()
    got = {r["metric"]: r["value"] for r in rows}
    want = {
        "Bleu_1": 0.55,
        "Bleu_2": 0.428174,
        "Bleu_3": 0.284043,
        "Bleu_4": 0.201143,
        "ROUGE_L": 0.522104,
        "CIDEr": 1.242192,
    }
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-5), name
    assert set(got) == set(report.OVERLAP)


@pytest.mark.parametrize(
    "hyp, refs, want",
    [
        (
            "this is a good test",
            ["this is a test", "this is also a test"],
            [0.799999, 0.632455, 0.5108729, 0.0000903602, 0.9070631],
        ),
        (
            "Le test est en français.",
            ["Test en français.", "Le test en français."],
            [0.799999, 0.632455, 0.0000051, 0, 0.9070631],
        ),
    ],
)
def test_single_pair_values(spark, hyp, refs, want):
    got = individual(spark, hyp, refs)
    names = [*report.BLEU, "ROUGE_L"]
    assert [got[n] for n in names] == pytest.approx(want, abs=1e-5)
    assert got["CIDEr"] == 0


def test_identical_pair(spark):
    got = individual(spark, "テスト", ["テスト"])
    assert got["METEOR"] == 1 and got["ROUGE_L"] == 1
    assert got["Bleu_1"] == pytest.approx(1, abs=1e-5)


def test_empty_hypothesis_scores_zero(spark):
    got = individual(spark, "", ["a b"])
    assert got["Bleu_4"] == pytest.approx(0, abs=1e-9) and got["METEOR"] == 0


def test_omitting_metrics(spark):
    left = report.chosen(["Bleu_3", "METEOR", "EmbeddingAverageCosineSimilairty"])
    assert left == ["Bleu_1", "Bleu_2", "ROUGE_L", "CIDEr", "VectorExtremaCosineSimilarity", "GreedyMatchingScore"]
    with pytest.raises(ValueError):
        report.chosen(["Bleu_9"])


def test_closest_reference_prefers_the_shorter(spark):
    row = spark.range(1).select(
        reference_length(F.array(F.lit(6), F.lit(4)), F.lit(5), "closest").alias("x")
    )
    assert row.first()["x"] == 4


def test_multi_bleu_is_zero_without_four_grams(spark):
    pairs = spark.createDataFrame([(0, "a b c", ["a b c"])], SCHEMA)
    row = multi_bleu(pairs).first()
    assert row["bleu"] == 0 and row["p3"] == 1 and row["p4"] == 0


def test_common_length_against_table():
    def table(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
        return rows[-1][-1]

    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(80))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(80))]
        assert common_length(a, b) == table(a, b)


def test_same_result_with_one_partition(spark, sf):
    pairs = V.eval_pairs(spark, sf)
    many = sorted(bleu_stats(pairs).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(bleu_stats(pairs).collect()) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def grams(txt, n):
    words = txt.split()
    return Counter(" ".join(words[k : k + n]) for k in range(len(words) - n + 1))


def brute_cider(pairs):
    """CIDEr from the definition, one pair and reference at a time."""
    out = {}
    for pair, hyp, refs in pairs:
        total = 0.0
        gap = sum(grams(hyp, 2).values())
        for ref in refs:
            cosines = 0.0
            for n in range(1, 5):
                def weigh(counts):
                    df = {g: max(1, sum(any(g in grams(r, n) for r in rs) for _, _, rs in pairs)) for g in counts}
                    return {g: c * (math.log(len(pairs)) - math.log(df[g])) for g, c in counts.items()}

                h, r = weigh(grams(hyp, n)), weigh(grams(ref, n))
                norms = math.sqrt(sum(w * w for w in h.values())) * math.sqrt(sum(w * w for w in r.values()))
                if norms > 0:
                    cosines += sum(min(h[g], w) * w for g, w in r.items() if g in h) / norms
            total += cosines * math.exp(-((gap - sum(grams(ref, 2).values())) ** 2) / 72)
        out[pair] = 10 * total / 4 / len(refs) if refs else 0.0
    return out


def test_any_number_of_references(spark):
    """One pair has 500 references, others none, one and three."""
    rng = random.Random(6)
    sentence = lambda n: " ".join(rng.choices("abcdefgh", k=n))
    pairs = [(0, sentence(12), [sentence(rng.randrange(15)) for _ in range(500)]), (1, sentence(7), [sentence(8)]), (2, "", [sentence(5)] * 3), (3, sentence(4), [])]
    frame = spark.createDataFrame(pairs, SCHEMA)
    stats = {r.pair_id: r for r in bleu_stats(frame).collect()}
    for pair, hyp, refs in pairs:
        for n in range(1, 5):
            best = Counter()
            for r in refs:
                best |= grams(r, n)
            assert stats[pair][f"correct_{n}"] == sum((grams(hyp, n) & best).values())
    assert {r.pair_id: r.CIDEr for r in cider(frame).collect()} == pytest.approx(brute_cider(pairs))
    want = {}
    for n in range(1, 5):
        for _, _, refs in pairs:
            for g in {g for r in refs for g in grams(r, n)}:
                want[n, g] = want.get((n, g), 0) + 1
    assert {(r.n, r.gram): r.df for r in cider_df(frame).collect()} == want
    assert len(bleu_stats(frame).columns) == 11


def test_best_matches_by_blocks():
    rng = np.random.default_rng(3)
    r, h = rng.normal(size=(23, 5)), rng.normal(size=(17, 5))
    r[4] = 0
    norm = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    sims = norm(r) @ norm(h).T
    for block in (1, 4, 17, 1024):
        best_r, best_h = best_matches(r, h, block)
        assert np.allclose(best_r, sims.max(axis=1)) and np.allclose(best_h, sims.max(axis=0))
    many = rng.normal(size=(20_000, 4))
    tracemalloc.start()
    best_matches(many, many)
    assert tracemalloc.get_traced_memory()[1] < 100e6  # the whole matrix has 3.2 GB
    tracemalloc.stop()
