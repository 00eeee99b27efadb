"""BLEU: additive statistics per pair, then one small formula per variant."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from styleops.functions import text
from styleops.operators.metrics.counts import ORDER, by_pair, gathered, grams

# Smoothing constants of the published scorer.
SMALL = 1e-9
TINY = 1e-15
ORDERS = range(1, ORDER + 1)


def reference_length(lengths: Column, testlen: Column, option: str) -> Column:
    if option == "shortest":
        return F.array_min(lengths).cast("double")
    if option == "average":
        total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
        return total.cast("double") / F.size(lengths)
    if option == "closest":
        near = F.transform(
            lengths, lambda x: F.struct(F.abs(x - testlen).alias("gap"), x.alias("len"))
        )
        return F.array_min(near)["len"].cast("double")
    raise ValueError(f"unknown reference length option {option!r}")


def matches(hyp: list[list[str]], refs: list[list[list[str]]], n: int) -> int:
    """n-grams of the hypothesis, each as often as there, and no more than in the reference that has it most.

    A side has one list of tokens as a rule, and one for each row that has the same key.
    """
    if not refs:
        return 0
    of_hyp = grams(hyp, n)
    if hyp in refs:
        return of_hyp.total()
    of_refs = [grams(ref, n) for ref in refs]
    return sum(min(cnt, max(r[g] if g in r else 0 for r in of_refs)) for g, cnt in of_hyp.items())


ROW_LENGTHS = StructType([StructField("testlen", LongType()), StructField("lengths", ArrayType(LongType()))])


@F.pandas_udf(StructType([*(StructField(f"correct_{n}", LongType()) for n in ORDERS), StructField("lengths", ArrayType(ROW_LENGTHS))]))
def pair_counts(hyps: pd.Series, refs: pd.Series) -> pd.DataFrame:
    """The matches of all rows of a pair together, and the lengths of both sides of each row."""

    def split(txt: str | None) -> list[str] | None:
        return None if txt is None else txt.split()

    out = []
    for copies in zip(hyps, refs):
        rows = [(split(h), None if of is None else [split(r) for r in of]) for h, of in zip(*copies)]
        whole = [row for row in rows if row[1] is not None]
        own = [h for h, _ in whole if h is not None]
        numbers = range(max((len(of) for _, of in whole), default=0))
        sides = [[of[k] for _, of in whole if k < len(of) and of[k] is not None] for k in numbers]
        size = lambda toks: None if toks is None else len(toks)
        lengths = [{"testlen": size(h), "lengths": None if of is None else [size(r) for r in of]} for h, of in rows]
        out.append([*(matches(own, sides, n) for n in ORDERS), lengths])
    return pd.DataFrame(out, columns=[*(f"correct_{n}" for n in ORDERS), "lengths"])


def bleu_stats(pairs: DataFrame, option: str = "closest") -> DataFrame:
    """``pair_id, testlen, reflen, guess_1..4, correct_1..4``.

    Matches are found inside the row of a pair; a pair may have any number of references. Rows that share a ``pair_id``
    are matched together.
    """
    correct = [f"correct_{n}" for n in ORDERS]
    counted = gathered(by_pair(pairs)).select("pair_id", pair_counts(F.col("copies.hyp"), F.col("copies.refs")).alias("m"))
    # rows without an id match nothing
    own = [F.when(F.col("pair_id").isNull(), F.lit(0)).otherwise(F.col(f"m.{c}")).alias(c) for c in correct]
    lengths = counted.select("pair_id", *own, F.explode("m.lengths").alias("c")).select("pair_id", *correct, "c.testlen", "c.lengths")
    guesses = [
        F.greatest(F.col("testlen") - (n - 1), F.lit(0)).cast("long").alias(f"guess_{n}") for n in ORDERS
    ]
    return lengths.select(
        "pair_id",
        "testlen",
        reference_length(F.col("lengths"), F.col("testlen"), option).alias("reflen"),
        *guesses,
        *correct,
    )


def corpus_totals(stats: DataFrame) -> DataFrame:
    names = ["testlen", "reflen", *[f"{c}_{n}" for c in ("guess", "correct") for n in ORDERS]]
    return stats.agg(*[F.sum(c).alias(c) for c in names])


def bleu_columns(order: int = ORDER) -> list[Column]:
    """Bleu_1..order from the statistics' columns, of one pair or of a corpus."""
    ratio = (F.col("testlen") + TINY) / (F.col("reflen") + SMALL)
    penalty = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(F.lit(1.0))
    product, out = F.lit(1.0), []
    for n in range(1, order + 1):
        product = product * ((F.col(f"correct_{n}") + TINY) / (F.col(f"guess_{n}") + SMALL))
        out.append((F.pow(product, F.lit(1.0 / n)) * penalty).alias(f"Bleu_{n}"))
    return out


def bleu_corpus(stats: DataFrame, order: int = ORDER) -> DataFrame:
    return corpus_totals(stats).select(*bleu_columns(order))


def bleu_sentence(stats: DataFrame, order: int = ORDER) -> DataFrame:
    return stats.select("pair_id", *bleu_columns(order))


def bleu_length_ratio(stats: DataFrame, special_reflen: float | None = None) -> DataFrame:
    """Hypothesis length over reference length, the latter optionally a given value per pair."""
    reflen = F.sum("reflen") if special_reflen is None else F.count(F.lit(1)) * F.lit(special_reflen)
    return stats.agg(F.sum("testlen").alias("testlen"), reflen.cast("double").alias("reflen")).withColumn(
        "ratio", (F.col("testlen") + TINY) / (F.col("reflen") + SMALL)
    )


def bleu_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Statistics are additive, so two sets merge by union."""
    return first.unionByName(second)


def bleu_retest(pairs: DataFrame, new_hyps: DataFrame, option: str = "closest") -> DataFrame:
    """Statistics of other hypotheses (``pair_id, hyp``) against the same references."""
    return bleu_stats(pairs.select("pair_id", "refs").join(new_hyps, "pair_id"), option)


def _geometric(precisions: list[Column]) -> Column:
    """exp of the mean log; a zero precision makes it zero."""
    logs = [F.when(p > 0, F.log(p)).otherwise(F.lit(-9999999999.0)) for p in precisions]
    return F.exp(sum(logs[1:], logs[0]) / len(logs))


def _brevity() -> Column:
    short = F.col("testlen") < F.col("reflen")
    return F.when(F.col("testlen") == 0, F.lit(0.0)).when(
        short, F.exp(1 - F.col("reflen") / F.col("testlen"))
    ).otherwise(F.lit(1.0))


def multi_bleu(pairs: DataFrame) -> DataFrame:
    """Unsmoothed corpus BLEU with its parts."""
    totals = corpus_totals(bleu_stats(pairs))
    ps = [
        F.when(F.col(f"guess_{n}") > 0, F.col(f"correct_{n}") / F.col(f"guess_{n}")).otherwise(F.lit(0.0))
        for n in ORDERS
    ]
    return totals.select(
        (_brevity() * _geometric(ps)).alias("bleu"),
        *[p.alias(f"p{n}") for n, p in zip(ORDERS, ps)],
        _brevity().alias("bp"),
        (F.col("testlen") / F.col("reflen")).alias("ratio"),
        F.col("testlen").alias("hyp_len"),
        F.col("reflen").cast("long").alias("ref_len"),
    )


def bleu_13a(pairs: DataFrame) -> DataFrame:
    """Corpus BLEU (0-100) on 13a tokens; the z-th zero precision counts as 1 / (2^z * guesses)."""
    tokenized = pairs.withColumns(
        {
            "hyp": text.tokenize_13a(text.rstrip(F.col("hyp"))),
            "refs": F.transform("refs", lambda r: text.tokenize_13a(text.rstrip(r))),
        }
    )
    totals = corpus_totals(bleu_stats(tokenized))
    zeros, ps = F.lit(0), []
    for n in ORDERS:
        guess, correct = F.col(f"guess_{n}"), F.col(f"correct_{n}")
        zeros = zeros + ((correct == 0) & (guess > 0)).cast("int")
        smoothed = F.when(correct == 0, 1 / (F.pow(F.lit(2.0), zeros) * guess)).otherwise(correct / guess)
        ps.append(F.when(guess > 0, smoothed).otherwise(F.lit(0.0)))
    return totals.select((100 * _brevity() * _geometric(ps)).alias("bleu"))
