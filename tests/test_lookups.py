"""Lookups of large tables: nothing is lost before the join."""

from pyspark.sql import functions as F

from styleops.operators import scale
from styleops.operators import tagging as T
from styleops.plans import views as V
from styleops.session import checkpointed


def test_a_large_lexicon_is_filtered_before_the_join(spark, sf):
    """With and without frequencies, a lexicon beyond the broadcast limit gives the same hits; few other candidates pass the filter."""
    corpus, lexicon = V.corpus_quality(spark, sf), checkpointed(V.lexicon(spark, sf))
    for phrases in (lexicon, lexicon.drop("freq")):
        near = {tuple(r) for r in T.phrase_hits(corpus, phrases).collect()}
        assert {tuple(r) for r in T.phrase_hits(corpus, phrases, broadcast_rows=0).collect()} == near and near
    keys = lexicon.select(F.col("main_style").alias("style"), F.col("term").alias("phrase"))
    found = T.phrase_candidates(corpus)
    passed = found.filter(scale.key_filter(keys, ["style", "phrase"])(F.col("style"), F.col("phrase")))
    true = found.join(keys, ["style", "phrase"], "left_semi").count()
    assert passed.join(keys, ["style", "phrase"], "left_semi").count() == true
    assert passed.count() - true < 0.1 * found.count()
    narrow = scale.key_filter(keys, ["style", "phrase"], most_bits=64)
    assert found.filter(narrow(F.col("style"), F.col("phrase"))).join(keys, ["style", "phrase"], "left_semi").count() == true
