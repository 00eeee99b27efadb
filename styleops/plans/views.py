"""Tables the registered queries start from, derived from the given parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styleops.functions import text
from styleops.functions.draws import hash_uniform
from styleops.operators.corpus import keep_tagged
from styleops.operators.lexicon import build_lexicon
from styleops.operators.ngrams import explode_windows
from styleops.operators.parallel import tagger_pairs_bimodal
from styleops.operators.scale import lookup_join, ordered_index
from styleops.operators.tagging import tag_sentences
from styleops.operators.vocab import build_vocab, encode_pairs, word_freq
from styleops.session import checkpointed, written

STYLES = ("q1", "q0")
_kept: dict[tuple[str, str, str], DataFrame] = {}


def once(name: str, spark: SparkSession, sf: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Write an intermediate table once per session; later queries read the written table."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _kept:
        _kept[key] = written(make())
    return _kept[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table to be exploded: dealt out by key if its files give fewer splits than there are cores.

    A large table has splits enough and is read as it lies, without a shuffle.
    """
    rows = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def _lines(rows: DataFrame, key, width: int) -> DataFrame:
    """One row for each line that is not blank; the key leaves room for the line number."""
    return (
        rows.select("*", F.posexplode(F.split("text", "\n", -1)).alias("line", "txt"))
        .filter(~text.is_blank(F.col("txt")))
        .withColumn("row_id", key * width + F.col("line"))
    )


def _split_of(key) -> F.Column:
    return F.when(key % 10 == 0, "test").when(key % 10 == 1, "val").otherwise("train")


def lines_of(docs: DataFrame) -> DataFrame:
    return _lines(docs, F.col("doc_id"), 100_000).select("row_id", "txt")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document: ``row_id, txt``."""
    return lines_of(spread_table(spark, sf, "documents", "doc_id"))


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    joined = docs.select("doc_id", "text").join(labels, "doc_id")
    return _lines(joined, F.col("doc_id"), 100_000).select(
        "row_id",
        "txt",
        F.concat(F.lit("q"), F.col("quality")).alias("style"),
        _split_of(F.col("doc_id")).alias("split"),
    )


def corpus_quality(spark: SparkSession, sf: str, lang: str | None = None) -> DataFrame:
    """Lines of the labelled documents, styled by their quality label."""
    docs = spread_table(spark, sf, "documents", "doc_id")
    if lang is not None:
        docs = docs.filter(F.col("lang") == lang)
    return quality_of(docs, table(spark, sf, "labels"))


def corpus_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the conversations, styled by who speaks."""
    key = F.col("conv_id") * 100 + F.col("turn")
    rows = spread_table(spark, sf, "conversations", "conv_id")
    return _lines(rows, key, 10_000).select(
        "row_id",
        "txt",
        F.col("role").alias("style"),
        _split_of(F.col("conv_id")).alias("split"),
    )


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return once("lexicon", spark, sf, lambda: build_lexicon(corpus_quality(spark, sf), STYLES))


def tagged(spark: SparkSession, sf: str, seed: int = 0) -> DataFrame:
    return once(
        f"tagged{seed}",
        spark,
        sf,
        lambda: tag_sentences(corpus_quality(spark, sf), lexicon(spark, sf), seed),
    )


def eval_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``pair_id, hyp, refs``: text without its tagged phrases against the text itself and a thinned copy."""

    def make() -> DataFrame:
        bare = text.squeeze_spaces(text.squeeze_spaces(text.remove_tags(F.col("tagged"), F.col("style"))))
        thinned = F.filter(text.ws_tokens(F.col("orig")), lambda t, i: i % 5 != 4)
        return tagged(spark, sf).select(
            F.col("row_id").alias("pair_id"),
            bare.alias("hyp"),
            F.array(F.col("orig"), F.array_join(thinned, " ")).alias("refs"),
        )

    return once("eval_pairs", spark, sf, make)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Tagger pairs of both styles; ``pair_id`` is unique."""
    return tagger_pairs_bimodal(keep_tagged(tagged(spark, sf)), STYLES)


def vocab_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the training source file, then of the target file: ``file_no, style_ord, pair_id, txt``."""
    train = pairs(spark, sf).filter("split = 'train'")
    sides = F.array(
        F.struct(F.lit(0).alias("file_no"), F.col("src").alias("txt")),
        F.struct(F.lit(1).alias("file_no"), F.col("tgt").alias("txt")),
    )
    return train.select("style_ord", "pair_id", F.explode(sides).alias("s")).select(
        "s.file_no", "style_ord", "pair_id", "s.txt"
    )


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    order = ["file_no", "style_ord", "pair_id"]
    return once("vocab", spark, sf, lambda: build_vocab(vocab_lines(spark, sf), order))


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    """``pair_id, src_ids, tgt_ids``."""
    return once("encoded", spark, sf, lambda: encode_pairs(pairs(spark, sf), vocab(spark, sf)))


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Four hypotheses per line with drawn log probabilities: ``sent_id, hyp_id, tokens, log_p``."""
    bare = text.remove_tags(F.col("tagged"), F.col("style"))
    texts = F.array("tagged", "orig", bare, F.concat_ws(" ", "tagged", "tagged"))
    rows = tagged(spark, sf).select(F.col("row_id").alias("sent_id"), F.posexplode(texts).alias("hyp_id", "txt"))
    tokens = F.concat(F.array(F.lit("<sos>")), text.ws_tokens(F.col("txt")), F.array(F.lit("<eos>")))
    log_p = F.log(1 - hash_uniform(F.col("sent_id"), F.col("hyp_id"), "beam"))
    return rows.select("sent_id", "hyp_id", tokens.alias("tokens"), log_p.alias("log_p"))


def token_log_probs(spark: SparkSession, sf: str) -> DataFrame:
    """Every token of the training targets with its unigram log probability."""
    rows = pairs(spark, sf).select("pair_id", text.wrap_target(F.col("tgt")).alias("txt"))
    cells = explode_windows(rows, ["pair_id"], text.ws_tokens(F.col("txt")), 1).withColumnRenamed("w0", "token")
    counts = checkpointed(cells.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")))
    total = counts.agg(F.sum("cnt")).first()[0]
    probs = counts.select("token", F.log(F.col("cnt") / F.lit(total)).alias("log_p"), "cnt")
    return lookup_join(cells, probs, ["token"], "cnt")


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``id, word, vec, cnt``: the most frequent words of the labelled lines take the vectors in turn."""

    def make() -> DataFrame:
        counts = word_freq(corpus_quality(spark, sf))
        placed = ordered_index(counts, [F.desc("freq"), F.col("word")], "vec_id")
        vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
        return placed.join(vectors, "vec_id").select(
            F.col("vec_id").alias("id"), "word", "vec", F.col("freq").alias("cnt")
        )

    return once("word_vectors", spark, sf, make)
