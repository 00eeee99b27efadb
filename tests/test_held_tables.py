"""Terms and phrases looked up inside a row: as the joins have them, also beyond what a worker holds."""

import pytest

from styleops.operators import lexicon, tagging


NUMBERS = ["freq", "df", "idf", "mean_tfidf"]


def by_term(stats):
    return {(r["style"], r["term"]): [r[c] for c in NUMBERS] for r in stats.collect()}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "row_id long, txt string, style string, split string")


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["red fish", "blue fish swims", "a1 b2 a1 b2", "the red fish", "the blue sky", "only here", ""]
    rows = [(k, " ".join(words[(k * j) % 7] for j in range(1, 4)), f"q{k % 3 % 2}", "train") for k in range(40)]
    rows += [rows[3], (4, "another text of row four", rows[4][2], "train"), (None, "red fish", "q1", "train"), (50, None, "q0", "val"), (51, "red fish", None, "val")]
    return labelled(spark, rows)


@pytest.mark.parametrize("held", [0, 6, 1000])
def test_statistics_of_terms(spark, corpus, held):
    used = corpus.filter("style IS NOT NULL")
    tf = lexicon.term_frequencies(used)
    idf = lexicon.doc_freq_idf(tf, used)
    want = by_term(lexicon.mean_tfidf(lexicon.tfidf_weights(tf, idf), used))
    got = by_term(lexicon.style_stats(used, held_terms=held))
    assert got.keys() == want.keys() and len(got) > 50
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_workers_sum_in_parts(spark, corpus, monkeypatch):
    used = corpus.filter("style IS NOT NULL")
    want = by_term(lexicon.style_stats(used))
    monkeypatch.setattr(lexicon, "SUMMED_TERMS", 2)
    monkeypatch.setattr(lexicon, "FLAT_CELLS", 2)
    got = by_term(lexicon.style_stats(used, held_terms=3))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_phrases_held_and_joined(spark, corpus, monkeypatch):
    phrases = [("q1", "red fish", 0.7), ("q1", "fish", 0.4), ("q0", "b2 a1 b2", 0.9), ("q0", "sky", 0.5), ("q0", "sky", 0.2), ("q1", "the", None), ("q0", "the", float("nan"))]
    lex = spark.createDataFrame(phrases, "main_style string, term string, score double")
    held = sorted(map(str, tagging.phrase_hits(corpus, lex, seed=3).collect()))
    monkeypatch.setattr(tagging, "HELD_PHRASES", 0)
    joined = sorted(map(str, tagging.phrase_hits(corpus, lex, seed=3).collect()))
    assert len(held) > 20 and held == joined


def test_held_phrases_make_no_candidates(spark, corpus, monkeypatch):
    def none(*_):
        raise AssertionError("candidates of every window")

    monkeypatch.setattr(tagging, "phrase_candidates", none)
    lex = spark.createDataFrame([("q1", "red fish", 1.0)], "main_style string, term string, score double")
    assert tagging.phrase_hits(corpus, lex).count() > 0


def test_styles_of_a_term_meet_without_a_further_shuffle(spark):
    rows = [(k, f"one two word{k % 7} word{k % 5}", f"q{k % 2}", "train") for k in range(40)]
    stats = lexicon.style_stats(spark.createDataFrame(rows, "row_id long, txt string, style string, split string"))
    plan = lexicon.class_report(stats, ("q1", "q0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(term") == 1 and "hashpartitioning(style" not in plan
