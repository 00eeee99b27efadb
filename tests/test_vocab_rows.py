"""Vocabulary and ids inside a row: as the joins have them."""

import pytest
from pyspark.sql import functions as F

from styleops.operators import vocab as VO
from styleops.functions import text


@pytest.fixture(scope="module")
def lines(spark):
    texts = ["a b a", "b c <sos> d", "", None, "d　a  e", "a b a", "f"]
    rows = [(k % 2, k if k != 5 else None, texts[k % 7]) for k in range(30)]
    return spark.createDataFrame([*rows, rows[4], (0, 4, "z a")], "file_no int, pair_id long, txt string")


def test_first_places(spark, lines, monkeypatch):
    places = lines.select("file_no", "pair_id", F.posexplode(text.ws_tokens(F.col("txt"))).alias("i", "token"))
    seen = places.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("file_no", "pair_id", "i")).alias("seen"))
    want = [r["token"] for r in seen.filter("cnt >= 2 AND token <> '<sos>'").orderBy(F.desc("cnt"), F.desc("seen")).collect()]
    for most in (1, 500_000):
        monkeypatch.setattr(VO, "SUMMED_TOKENS", most)
        got = VO.build_vocab(lines, ["file_no", "pair_id"]).orderBy("id").collect()
        assert [r["token"] for r in got[5:]] == want and [r["id"] for r in got] == list(range(len(got)))


def test_tokens_are_not_sorted_to_be_counted(spark, lines, monkeypatch):
    def none(*_):
        raise AssertionError("a row for each token")

    monkeypatch.setattr(VO, "explode_windows", none)
    vocab = VO.weighted(VO.build_vocab(lines, ["file_no", "pair_id"]))
    assert VO.encode_ids(lines, "pair_id", F.col("txt"), vocab, "ids").count() > 20


def test_ids_held_and_joined(spark, lines, monkeypatch):
    table = VO.build_vocab(lines, ["file_no", "pair_id"])
    odd = spark.createDataFrame([(1, [1, 5, 6, 2]), (2, []), (3, None), (4, [99, None, 5]), (5, [6, 5]), (5, [5, 99, 7]), (None, [5])], "pair_id long, ids array<int>")

    def both():
        vocab = VO.weighted(table)
        ids = VO.encode_ids(lines, "pair_id", F.col("txt"), vocab, "ids")
        return [sorted(map(str, x.collect())) for x in (ids, VO.decode_ids(odd, "pair_id", "ids", table))]

    held = both()
    monkeypatch.setattr(VO, "HELD_TOKENS", 0)
    assert held == both()
