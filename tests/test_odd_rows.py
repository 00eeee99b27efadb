"""Null and blank texts, pairs without references, wide n-grams, parted words."""

from pyspark.sql import functions as F

from styleops.functions import text
from styleops.operators import tagging as T
from styleops.operators import vocab as V
from styleops.operators.metrics.rouge import rouge_l
from styleops.operators.ngrams import explode_ngrams


def test_rouge_keeps_every_pair(spark):
    rows = [(1, None, ["a b"]), (2, "a b", [None, "a b"]), (3, "a b", []), (4, "a b", None)]
    got = {r.pair_id: r.ROUGE_L for r in rouge_l(spark.createDataFrame(rows, "pair_id long, hyp string, refs array<string>")).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}


def test_ngrams_of_any_width(spark):
    rows = spark.createDataFrame([(1, " ".join("abcdefghijkl"))], "id long, txt string")
    got = {r.n: r.gram for r in explode_ngrams(rows, ["id"], F.split("txt", " "), 9, 12).orderBy(F.desc("gram")).collect()}
    assert got == {n: " ".join("abcdefghijkl"[:n]) for n in range(9, 13)}


def test_13a_joins_a_word_parted_at_a_line_end(spark):
    df = spark.createDataFrame([("well-\nknown\nfact.",)], "txt string")
    assert df.select(text.tokenize_13a(F.col("txt")).alias("x")).first().x == "wellknown fact ."


def test_rows_without_tokens_stay(spark):
    vocab = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*V.SPECIALS, "a"])], "id int, token string, cnt long")
    rows = spark.createDataFrame([(1, "a b a"), (2, " "), (3, None), (4, "")], "pair_id long, txt string")
    ids = V.encode_ids(rows, "pair_id", F.col("txt"), V.weighted(vocab), "ids")
    assert sorted(map(tuple, ids.collect())) == [(1, [5, V.UNK, 5]), (2, []), (3, []), (4, [])]
    back = V.decode_ids(ids, "pair_id", "ids", vocab)
    assert sorted(map(tuple, back.collect())) == [(1, "a <unk> a"), (2, ""), (3, ""), (4, "")]
    scores = spark.createDataFrame([(5, 1.0, 1)], "id int, score double, cnt long")
    masked = T.mask_tokens(ids, "ids", scores)
    assert sorted(map(tuple, masked.collect())) == [(1, [V.GMASK, V.UNK, V.GMASK]), (2, []), (3, []), (4, [])]
