"""Terms, tags and ids found in blocks of rows: as the joins have them, without a row for each term, hit or token."""

import pytest
from pyspark.sql import functions as F

from styleops.operators import lexicon, tagging
from styleops.operators import vocab as VO


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["red fish", "blue fish swims", "a1 b2 a1 b2", "the red fish", "the blue sky", "only here", ""]
    rows = [(k, " ".join(words[(k * j) % 7] for j in range(1, 4)), f"q{k % 3 % 2}", "train") for k in range(60)]
    rows += [rows[3], (4, "the fish of row four", "q0", "train"), (4, "red fish sky", None, "val"), (None, "red fish", "q1", "train"), (None, "the sky", "q1", "val")]
    return spark.createDataFrame([*rows, (50, None, "q0", "val"), (99, "  ", "q1", "val")], "row_id long, txt string, style string, split string")


@pytest.mark.parametrize("rows", [4, 16_384])
def test_report_of_shared_terms(spark, corpus, rows, monkeypatch):
    monkeypatch.setattr(lexicon, "BLOCK_ROWS", rows)
    monkeypatch.setattr(lexicon, "PART_ROWS", rows)
    used = corpus.filter("style IS NOT NULL AND txt IS NOT NULL")

    def report(stats):
        return {(r["main_style"], r["term"]): [r[c] for c in ("freq", "main_mean", "rel_mean", "main_idf")] for r in lexicon.class_report(stats, ("q1", "q0")).collect()}

    stats = lexicon.shared_stats(used, ("q1", "q0"), 1, 3, 2)
    want, got = report(lexicon.style_stats(used, 1, 3)), report(stats)
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    seen = {(r["style"], r["term"]) for r in stats.collect()}
    assert all((s, t) in seen for _, t in seen for s in ("q1", "q0"))


@pytest.mark.parametrize("options", [{}, {"concat": False, "pos_weight": 2, "max_pos": 1}])
def test_tags_inside_rows(spark, corpus, options, monkeypatch):
    phrases = [("q1", "red fish", 0.7), ("q1", "fish", 0.4), ("q0", "b2 a1 b2", 0.9), ("q0", "sky", 0.5), ("q0", "a1", 0.8), ("q1", "swims the", 1.0), ("q1", "sky", float("nan")), ("q1", "sky", 0.1), ("q1", "the", None), ("q0", "red  fish", 1.0), (None, "fish", 1.0), ("q0", "a1 b2 a1 b2 blue", 1.0)]
    lex = spark.createDataFrame(phrases, "main_style string, term string, score double")
    held = tagging.tag_by_join(corpus, lex, 3, **options)
    plan = held._jdf.queryExecution().executedPlan().toString()
    held = sorted(map(str, held.collect()))
    monkeypatch.setattr(tagging, "HELD_PHRASES", 0)
    monkeypatch.setattr(tagging, "PACKED_PHRASES", 0)
    assert held == sorted(map(str, tagging.tag_by_join(corpus, lex, 3, **options).collect()))
    assert sum("[q" in r for r in held) > 20 and plan.count("Exchange") == 1


@pytest.mark.parametrize("most", [0, 3, 500_000])
def test_ids_of_pairs(spark, most, monkeypatch):
    def none(*_):
        raise AssertionError("a row for each token")

    texts = ["a b a", "b c <sos> d", "", None, "d　a  e", "f g h i j", "x"]
    rows = [(k if k != 5 else None, texts[k % 7], texts[k * 3 % 7]) for k in range(40)] + [(4, "z a", "a"), (4, None, "b"), (3, "q a", None)]
    pairs = spark.createDataFrame(rows, "pair_id long, src string, tgt string")
    vocab = VO.build_vocab(pairs.select("pair_id", F.explode(F.array("src", "tgt")).alias("txt")), ["pair_id"])
    number = {r["token"]: r["id"] for r in vocab.collect()}

    def side(copies, shape):
        ids = [[number.get(t, VO.UNK) for t in shape(c).split()] for c in copies if c is not None]
        whole = [[x for _, x in sorted((i, x) for row in ids for i, x in enumerate(row))]] if len(ids) > 1 else ids
        return whole + [[] for c in copies if c is None]

    want = []
    for key in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == key]
        want += [(key, s, t) for s in side([r[1] for r in own], "{} <eos>".format) for t in side([r[2] for r in own], "<sos> {} <eos>".format)]
    monkeypatch.setattr(VO, "HELD_TOKENS", most)
    monkeypatch.setattr(VO, "explode_windows", none)
    assert sorted(map(tuple, VO.encode_pairs(pairs, vocab).collect())) == sorted(want)


def test_different_keys_are_not_shuffled(spark):
    pairs = spark.createDataFrame([(k, "a b", "a c") for k in range(20)], "pair_id long, src string, tgt string")
    vocab = VO.build_vocab(pairs.select("pair_id", F.col("src").alias("txt")), ["pair_id"])
    assert "Exchange" not in VO.encode_pairs(pairs, vocab)._jdf.queryExecution().executedPlan().toString()


def test_found_digests_are_compared():
    phrases = tagging.PackedPhrases(["a b", "c"], [0.5, 1.0])
    assert phrases.found([["a", "b", "c"], [], ["c"]]) == [[(0, 2, 0.5), (2, 1, 1.0)], [], [(0, 1, 1.0)]]
    phrases.texts = tagging.pa.array(["x", "y"])  # as if digests of other words met
    assert phrases.found([["a", "b", "c"]]) == [[]]
