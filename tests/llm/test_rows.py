"""Stages decide by row: null and repeated ids, columns of any name and type, doubled cache rows, empty tables."""

import datetime

import public_tokenizers as P
import pytest

from styleops.llm import exact_dedup, jaccard_join, quality, substring_dedup, token_counts
from styleops.session import scratch_path

WHEN = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
SCHEMA = "doc_id long, text string, `a.b` timestamp, _digest string, _rank map<int,string>, `back``tick` decimal(20,3), rest string, row int, `c0` int, content string"
FLUENT = "The people walked along the river and talked about the weather, as they had done on every evening of that long summer."
JUNK = "### $$$ %%% *** &&& ### $$$ @@@ +++ {}{}{} <<>> ### $$$ %%%"


def rows(spark, texts):
    extra = [WHEN, "digest", {1: "one", 2: None}, None, "rest", 5, 7, "x"]
    return spark.createDataFrame([(i, t, *extra) for i, t in texts], SCHEMA).repartition(3)


def untouched(docs, out, names):
    assert out.columns == docs.columns + names
    for r in out.collect():
        assert r["a.b"] == WHEN and r["_digest"] == "digest" and r["_rank"] == {1: "one", 2: None} and (r["rest"], r["row"], r["c0"]) == ("rest", 5, 7)


def test_quality_by_row(spark):
    good = [(k, f"{FLUENT} {FLUENT.replace('river', w)}") for k, w in enumerate(["road", "lake", "field", "shore", "wall", "hill"] * 20)]
    bad = [(k, f"{JUNK} {k}{JUNK}") for k in range(1000, 1120)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    odd = [(None, good[0][1]), (None, bad[0][1]), (5, bad[1][1]), (1005, good[1][1])]
    docs = rows(spark, good + bad + odd)
    out = quality.keep_quality(docs, labels)
    untouched(docs, out, [])
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == len(good) + 2 and (None, good[0][1]) in kept and (1005, good[1][1]) in kept
    assert not any(JUNK in t for _, t in kept)
    assert quality.keep_quality(docs.limit(0), labels).count() == 0
    again = quality.quality_scores(docs.repartition(7), labels)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, quality.quality_scores(docs, labels).collect()), key=str)


def test_near_copies_by_row(spark):
    near = [f"{FLUENT} {FLUENT.lower()} and so on", f"{FLUENT} {FLUENT.lower()} and so forth"]
    texts = [(None, near[0]), (None, near[1]), (None, near[1]), (None, "alone without id, in words of its own"), (7, "seven words that stand for themselves here"), (7, near[0]), (9, near[1]), (9, near[1])]
    texts += [(11, "twice with one id and one text"), (11, "twice with one id and one text"), (None, ""), (12, None), (13, " ")]
    docs = rows(spark, texts)
    out = jaccard_join.keep_one_of_each(docs)
    untouched(docs, out, [])
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(None, texts[3][1]), texts[4], (7, near[0]), texts[8], (None, ""), (12, None), (13, " ")]
    assert kept == sorted(want, key=str)
    only = rows(spark, [(None, near[0]), (None, near[1])])
    assert jaccard_join.keep_one_of_each(only).count() == 1 and jaccard_join.keep_one_of_each(docs.limit(0)).count() == 0


def test_exact_copies_by_row(spark):
    docs = rows(spark, [(1, "Same"), (2, "same"), (None, "same"), (None, "other"), (None, "other")])
    out = exact_dedup.drop_exact_copies(docs)
    untouched(docs, out, [])
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(2, "same"), (None, "other")], key=str)


def test_repeats_carry_other_columns(spark):
    docs = rows(spark, [(1, FLUENT * 4), (2, f"Own. {FLUENT * 4} Own too."), (None, None)])
    out = substring_dedup.remove_repeats(docs)
    untouched(docs, out, ["removed"])
    assert {(r.doc_id, len(r.removed)) for r in out.collect()} == {(1, 0), (2, 1), (None, 0)} or out.filter("doc_id = 2").first().text != docs.filter("doc_id = 2").first().text


@pytest.mark.parametrize("copies", [1, 2])
def test_doubled_cache_rows_count_once(spark, copies):
    path, cache = P.path("word_bpe_49k.json"), scratch_path(spark, "cache")
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (None, None)], "doc_id long, text string")
    want = sorted(map(tuple, token_counts.count_tokens(docs, path, cache).collect()), key=str)
    for _ in range(copies):
        spark.read.parquet(cache).write.mode("append").parquet(cache)
    assert sorted(map(tuple, token_counts.count_tokens(docs, path, cache).collect()), key=str) == want
