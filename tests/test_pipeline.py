import re

import pytest
from pyspark.sql import functions as F

from styleops.functions import noise, text
from styleops.operators import batching, corpus, lexicon, parallel, scale, tagging, vocab
from styleops.plans import views as V

CORPUS = "row_id long, txt string, style string, split string"
SENTENCE = "please get back to me if you have any additional concerns ."


def phrases(spark, *terms, style="P_9", score=1.0):
    return spark.createDataFrame([(style, t, score) for t in terms], "main_style string, term string, score double")


def tag(spark, txt, *terms, **options):
    rows = spark.createDataFrame([(0, txt, "P_9", "train")], CORPUS)
    return tagging.tag_by_join(rows, phrases(spark, *terms), **options).first()["tagged"]


def test_worked_example(spark):
    terms = ["please get", "if you", "any", "additional"]
    assert tag(spark, SENTENCE, *terms) == "[P_90] back to me [P_91] have [P_92] concerns ."
    apart = tag(spark, SENTENCE, *terms, concat=False)
    assert apart == "[P_90] back to me [P_91] have [P_92] [P_93] concerns ."


def test_tagging_edges(spark):
    assert tag(spark, "   ", "a") == ""
    assert tag(spark, "thanks", "thanks") == "[P_90]"
    assert tag(spark, "many thanks", "thanks") == "many [P_90]"
    assert tag(spark, "a b c d e", "a b c", "a") == "[P_90] d e"
    assert tag(spark, "Thanks a lot", "thanks") == "Thanks a lot"
    long = " ".join(["x"] * 70 + ["thanks"])
    assert tag(spark, long, "thanks").endswith("[P_920]")


def test_pairs_of_the_worked_example(spark):
    kept = spark.createDataFrame(
        [(1, "P_9", "val", SENTENCE, "[P_90] back to me [P_91] have [P_92] concerns .")],
        "row_id long, style string, split string, orig string, tagged string",
    )
    t = parallel.tagger_pairs_unimodal(kept, ("P_9", "P_0")).first()
    assert (t["split"], t["src"]) == ("dev", "back to me have concerns .")
    g = parallel.generator_pairs_unimodal(kept, ("P_9", "P_0")).first()
    assert (g["src"], g["tgt"]) == (t["tgt"], SENTENCE)


def test_spacing_is_one_pass(spark):
    row = spark.range(1).select(text.squeeze_spaces(F.lit("  a   b ")).alias("x")).first()
    assert row["x"] == "a  b"


def test_label_as_plain_text_is_kept(spark):
    rows = spark.createDataFrame([("about P_9 only", "P_9"), ("nothing", "P_9")], "tagged string, style string")
    assert corpus.keep_tagged(rows).count() == 1


def test_null_split_feeds_the_lexicon(spark):
    rows = spark.createDataFrame([(0, "a", "x", None), (1, "b", "x", "test"), (2, None, "x", "train")], CORPUS)
    assert [r["row_id"] for r in corpus.lexicon_input(rows).collect()] == [0]


def test_wide_spaces_split_tokens(spark):
    line = "a b　 c\x1cd\te"
    row = spark.range(1).select(text.ws_tokens(F.lit(line)).alias("t")).first()
    assert row["t"] == line.split()


def test_english_lexicon_sizes(spark):
    sf = "/root/testdata/sf0.01"
    report = lexicon.build_report(V.corpus_quality(spark, sf, lang="en"), V.STYLES).cache()
    sizes = {r["main_style"]: r["count"] for r in report.groupBy("main_style").count().collect()}
    assert sizes == {"q1": 2418, "q0": 960}
    chosen = lexicon.lexicon_select(report)
    assert {r["main_style"]: r["count"] for r in chosen.groupBy("main_style").count().collect()} == {"q1": 242, "q0": 97}
    top = report.filter("main_style = 'q1'").orderBy(F.desc("ratio")).first()
    assert top["term"] == "ononst the" and top["ratio"] == pytest.approx(44.056451118386)
    total = report.groupBy("main_style").agg(F.sum("prob").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in total)
    assert chosen.groupBy("main_style").agg(F.max("score").alias("m")).filter("abs(m - 1) > 1e-9").count() == 0


def test_lexicon_without_broadcast(spark, sf, monkeypatch):
    want = sorted(map(tuple, V.lexicon(spark, sf).select("main_style", "term", F.round("score", 9)).collect()))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(scale.lookup_join, "__defaults__", ("inner", 5))
    monkeypatch.setattr(scale.bounded, "__defaults__", (5,))
    monkeypatch.setattr(scale, "HEAVY_KEYS", 50)
    built = lexicon.build_lexicon(V.corpus_quality(spark, sf), V.STYLES)
    assert sorted(map(tuple, built.select("main_style", "term", F.round("score", 9)).collect())) == want
    rows = V.corpus_quality(spark, sf)
    tagged = tagging.tag_by_join(rows, built).select("row_id", "tagged")
    assert tagged.exceptAll(V.tagged(spark, sf).select("row_id", "tagged")).count() == 0


def test_tags_never_adjacent_and_text_is_a_subsequence(spark, sf):
    mark = re.compile(r"\[q[01][0-9]+\]$")
    for r in V.tagged(spark, sf).collect():
        out = r["tagged"].split()
        assert not any(mark.match(a) and mark.match(b) for a, b in zip(out, out[1:]))
        rest = iter(r["orig"].split())
        assert all(w in rest for w in out if not mark.match(w))


def test_ordered_index_with_one_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), F.hash("id").alias("v"), "id"
    )
    got = scale.ordered_index(rows, [F.desc("v"), F.col("id")], "n", ["g"]).toPandas()
    want = got.sort_values(["v", "id"], ascending=[False, True])
    assert (want.groupby("g").cumcount() == want["n"]).all() and len(got) == 5000


def test_vocab_specials_take_no_new_id(spark):
    lines = spark.createDataFrame([(0, "b b a a <eos> <eos> <eos> c")], "line long, txt string")
    ids = {r["token"]: r["id"] for r in vocab.build_vocab(lines, ["line"]).collect()}
    assert ids == {"<pad>": 0, "<sos>": 1, "<eos>": 2, "<unk>": 3, "[GMASK]": 4, "a": 5, "b": 6}
    small = {r["token"] for r in vocab.build_vocab(lines, ["line"], max_size=2).collect()}
    assert small == {*vocab.SPECIALS, "a"}


def test_batches_keep_their_bounds(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("pair_id"),
        (1 + F.pmod(F.hash("id"), F.lit(90))).alias("src_len"),
        F.when(F.col("id") == 7, 900).otherwise(1 + F.pmod(F.hash("id", F.lit(1)), F.lit(90))).alias("tgt_len"),
    )
    got = batching.pack_batches(rows, 4, max_tokens=800, max_size=16).join(rows, "pair_id").toPandas()
    assert len(got) == 3000 and list(got[got.batch_no < 0].pair_id) == [7]
    for _, b in got[got.batch_no >= 0].groupby(["shard", "batch_no"]):
        assert len(b) <= 16 and (b.src_len.max() + b.tgt_len.max()) * len(b) <= 800
        assert sorted(b.pos) == list(range(len(b)))


def test_padding_mask_leaves_the_first_pad_open(spark):
    row = spark.range(1).select(
        batching.pad_mask(F.array(*map(F.lit, [5, 6, 0, 0])), F.lit(2)).alias("m"),
        batching.pad_mask(F.array(*map(F.lit, [5, 6, 0, 0])), F.lit(2), False).alias("s"),
    ).first()
    assert row["m"] == [False, False, False, True] and row["s"] == [False, False, True, True]


def test_noise_keeps_length_and_specials(spark):
    rows = spark.range(200).select("id", F.array(*map(F.lit, [1, 7, 8, 9, 3, 10, 2, 0])).alias("ids"))
    for fn in (
        noise.word_shuffle(F.col("ids"), F.col("id"), 2),
        noise.word_drop(F.col("ids"), F.col("id"), 0.5),
        noise.word_blank(F.col("ids"), F.col("id"), 0.5),
        noise.word_substitute(F.col("ids"), F.col("id"), 0.5, 50),
        noise.marker_shuffle(F.col("ids"), F.col("id"), 6),
    ):
        out = rows.select(fn.alias("x")).collect()
        assert all(len(r["x"]) == 8 and r["x"][0] == 1 for r in out)
    longer = rows.select(noise.insert_tags(F.col("ids"), F.col("id"), 1.0).alias("x")).first()["x"]
    assert len(longer) == 16 and longer[-1] == 0
