"""An interpolated bigram model with continuation counts, as a source of log probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styleops.operators import scale
from styleops.operators.ngrams import explode_windows
from styleops.session import written

#: Taken from each count of a seen pair, and the share of the even distribution over all ids.
DISCOUNT = 0.75
EVEN = 0.01


def bigram_counts(rows: DataFrame, ids: str, by: Sequence[str] = ()) -> DataFrame:
    """``*by, before, id, n``: adjacent ids of the arrays ``ids``, added up where they are made before they are shuffled."""
    pairs = explode_windows(rows, list(by), F.col(ids), 2).filter("w1 IS NOT NULL")
    return pairs.groupBy(*by, F.col("w0").alias("before"), F.col("w1").alias("id")).agg(F.count(F.lit(1)).alias("n"))


class BigramModel:
    """Probabilities of an id after another one.

    A seen pair has (n - d) / N of its context's N; what the discounts d leave over is shared by all ids in proportion to the number of
    contexts each follows, mixed with an even share. After a context that was never seen that share alone counts. The
    probabilities of each context sum to one.
    """

    def __init__(self, rows: DataFrame, ids: str, vocab_size: int, discount: float = DISCOUNT, even: float = EVEN):
        self._learn(written(bigram_counts(rows, ids)), vocab_size, discount, even)

    @classmethod
    def of_counts(cls, counts: DataFrame, vocab_size: int, discount: float = DISCOUNT, even: float = EVEN) -> BigramModel:
        """The model of pairs that are counted (``before, id, n``) and written already."""
        model = cls.__new__(cls)
        model._learn(counts.select("before", "id", "n"), vocab_size, discount, even)
        return model

    def _learn(self, pairs: DataFrame, vocab_size: int, discount: float, even: float) -> None:
        self.pairs = pairs
        self.contexts = self.pairs.groupBy("before").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        self.followers = self.pairs.groupBy("id").agg(F.count(F.lit(1)).alias("contexts"))
        self.kinds, self.vocab_size, self.discount, self.even = self.pairs.count(), vocab_size, discount, even

    def _probability(self) -> Column:
        share = F.coalesce("contexts", F.lit(0)) * ((1 - self.even) / self.kinds if self.kinds else 0.0)
        rest = share + F.lit((self.even if self.kinds else 1.0) / self.vocab_size)
        seen = F.greatest(F.coalesce("seen", F.lit(0)) - self.discount, F.lit(0.0)) / F.col("total")
        return F.when(F.col("total").isNull(), rest).otherwise(seen + self.discount * F.col("kinds") / F.col("total") * rest)

    def log_probabilities(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (``before, id`` and more) with ``log_p``; give them counted, so that a pair is looked up once."""
        known = self.pairs.withColumnRenamed("n", "seen")
        found = scale.lookup_join(pairs, known.withColumn("_often", F.col("seen")), ["before", "id"], "_often", "left")
        found = scale.small_join(found, self.contexts, ["before"], "left")
        found = scale.small_join(found, self.followers, ["id"], "left")
        return found.select(*pairs.columns, F.log(self._probability()).alias("log_p"))

    def perplexity(self, rows: DataFrame, ids: str, by: Sequence[str] = ()) -> DataFrame:
        """``*by, tokens, perplexity``: exp of the mean negative log probability of every id but the first of each row."""
        return self.perplexity_of_counts(bigram_counts(rows, ids, by), by)

    def perplexity_of_counts(self, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """The same of pairs that are counted already: ``*by, before, id, n``."""
        scored = self.log_probabilities(counts)
        mean = -F.sum(F.col("n") * F.col("log_p")) / F.sum("n")
        return scored.groupBy(*by).agg(F.sum("n").alias("tokens"), F.exp(mean).alias("perplexity"))
