"""Choose among hypotheses ``sent_id, hyp_id, tokens, log_p`` (tokens start with <sos>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def nbest_topk(hyps: DataFrame, k: int, len_penalty: float = 0.0) -> DataFrame:
    """The k best by length-normalized log probability; of equal ones the later stands higher.

    Spark keeps only k rows per sentence in each task before it shuffles.
    """
    score = F.col("log_p") / F.pow(F.size("tokens").cast("double"), F.lit(len_penalty))
    best = W.partitionBy("sent_id").orderBy(F.desc("score"), F.desc("hyp_id"))
    return (
        hyps.withColumn("score", score)
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k)
    )


def nbest_prefer_tag(hyps: DataFrame, label: str, k: int, len_penalty: float = 0.0) -> DataFrame:
    """Of the k best, the one with most tokens that contain the label; ties go to the better score."""
    n_tags = F.size(F.filter("tokens", lambda t: F.contains(t, F.lit(label))))
    value = F.struct(n_tags.alias("n_tags"), "score", "hyp_id")
    return (
        nbest_topk(hyps, k, len_penalty)
        .groupBy("sent_id")
        .agg(F.max_by(F.struct("hyp_id", "tokens", "score"), value).alias("b"), F.max(n_tags).alias("n_tags"))
        .select("sent_id", "b.hyp_id", "b.tokens", "b.score", "n_tags")
    )


def truncate_output(tokens: Column, max_len: int = 200) -> Column:
    """Tokens after <sos> up to the first <eos>, ``max_len`` at most."""
    end = F.array_position(tokens, F.lit("<eos>"))
    until = F.when(end > 0, end - 2).otherwise(F.size(tokens) - 1)
    return F.slice(tokens, 2, F.least(until, F.lit(max_len)).cast("int"))
