"""The document pipeline: each stage on what the one before it kept, against brute force."""

import corpus_pipeline
from styleops.llm import exact_dedup, jaccard_join, quality, substring_dedup
from styleops.llm.common import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "substring_dedup", "packing"]
    good, single, apart, cut = (f for _, f in corpus_pipeline.STAGES[:4])
    first = written(good(spark, docs, sf), "first")
    bad = {r.doc_id for r in quality.quality_scores(docs, table(spark, sf, "labels")).filter("predicted = 0").collect()}
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} - bad and bad
    second = written(single(spark, first, sf), "second")
    last = {}
    for r in first.collect():
        last[r.text.lower()] = max(r.doc_id, last.get(r.text.lower(), r.doc_id))
    assert {r.doc_id for r in second.collect()} == set(last.values())
    third = written(apart(spark, second, sf), "third")
    assert {r.doc_id for r in third.collect()} == {r.component_id for r in jaccard_join.jaccard_groups(second).collect()}
    fourth = written(cut(spark, third, sf), "fourth")
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    assert {(r.doc_id, r.text) for r in fourth.collect()} == {(r.doc_id, r.text) for r in substring_dedup.remove_repeats(third).collect()}
    assert all(r.n_chars == len(r.text) for r in fourth.collect())
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in fourth.collect()}
    assert exact_dedup.exact_groups(fourth).count() == fourth.count()
