"""Similarity of word vectors: average, extrema and greedy matching."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleops.operators import scale
from styleops.operators.metrics.counts import by_pair, token_sides
from styleops.session import checkpointed


#: Words whose vectors every worker holds. A vector of 300 numbers takes about 2.5 kilobytes.
WIDE_ROWS = 50_000
#: Tokens of either side whose cosines are held at once.
BLOCK = 1024


def mean_vector(vectors: DataFrame) -> list[float]:
    """The vector of unknown words: one mean per dimension, computed on the executors."""
    means = (
        vectors.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x"))
    )
    return [row["x"] for row in means.orderBy("d").collect()]


def word_table(vectors: DataFrame) -> DataFrame:
    """``word, vec, known, unknown, cnt``: one row a word, with how many of its rows have a vector and how many have none."""
    return vectors.filter("word IS NOT NULL").groupBy("word").agg(
        F.first("vec", ignorenulls=True).alias("vec"),
        F.count("vec").alias("known"),
        F.count_if(F.col("vec").isNull()).alias("unknown"),
        F.max("cnt").alias("cnt"),
    )


def rare_words(laid: DataFrame, rare: DataFrame) -> DataFrame:
    """``pair_id, rare``: of each pair the words that are in ``rare``, with their vectors.

    A filter of bits drops nearly all other words where they are made, so only rare words and their vectors are shuffled.
    """
    words = token_sides(laid).select("pair_id", F.explode(F.array_distinct(F.split(F.concat_ws(" ", "hyp", "refs"), r"\s"))).alias("word"))
    words = words.filter(F.col("pair_id").isNotNull() & scale.key_filter(rare, ["word"])(F.col("word")))
    found = words.join(rare.select("word", "vec", "known", "unknown"), "word")
    return found.groupBy("pair_id").agg(F.collect_list(F.struct("word", "vec", "known", "unknown")).alias("rare"))


def entries(side: str, places: dict, matrix: np.ndarray, rare: dict, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and vectors of a side's distinct known words, unknown ones as one entry."""
    at, counts, vecs, more, lost = [], [], [], [], 0
    for word, times in Counter(side.split()).items():
        if (found := places.get(word)) is not None:
            place, known, none = found
            if known:
                at.append(place)
                counts.append(times * known)
            lost += times * none
        elif (found := rare.get(word)) is not None:
            vec, known, none = found
            if known:
                vecs.append(vec)
                more.append(times * known)
            lost += times * none
        else:
            lost += times
    if lost:
        vecs.append(unknown)
        more.append(lost)
    known_rows = matrix[at]
    return np.array(counts + more, dtype=float), np.vstack([known_rows, *vecs]) if len(at) and vecs else known_rows if len(at) else np.stack(vecs)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    scale_ = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / scale_ if scale_ > 0 else 0.0


def extrema(m: np.ndarray) -> np.ndarray:
    """Per dimension the extreme that is further from zero; the smallest on a tie, or if it is zero."""
    most, least = m.max(axis=0), m.min(axis=0)
    nearer = (least < 0) & (-least < most)
    return np.where(nearer | (least > 0), most, least)


def best_matches(r: np.ndarray, h: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``r`` and of ``h`` the highest cosine with a row of the other; maxima of blocks are combined,
    so no more than ``block`` squared cosines are held at once."""

    def unit(m):
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

    r, h = unit(r), unit(h)
    best_r, best_h = np.full(len(r), -np.inf), np.full(len(h), -np.inf)
    for i in range(0, len(r), block):
        for j in range(0, len(h), block):
            sims = r[i : i + block] @ h[j : j + block].T
            best_r[i : i + block] = np.maximum(best_r[i : i + block], sims.max(axis=1))
            best_h[j : j + block] = np.maximum(best_h[j : j + block], sims.max(axis=0))
    return best_r, best_h


def greedy(hc: np.ndarray, h: np.ndarray, rc: np.ndarray, r: np.ndarray) -> float:
    best_r, best_h = best_matches(r, h)
    return float((np.average(best_h, weights=hc) + np.average(best_r, weights=rc)) / 2)


# Metric names as users of the published scorer know them, spelling included.
MEASURES = {
    "EmbeddingAverageCosineSimilairty": lambda a, x, b, y: cosine(a @ x, b @ y),
    "VectorExtremaCosineSimilarity": lambda a, x, b, y: cosine(extrema(x), extrema(y)),
    "GreedyMatchingScore": greedy,
}


def _scorer(names, words, unknown):
    """Scores of each pair, the best over its references; 0 without tokens on either side. ``words``: a broadcast table."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(hyps: pd.Series, refs: pd.Series, rare: pd.Series) -> pd.DataFrame:
        places, matrix = words.value
        out = []
        for hyp, many, own in zip(hyps, refs, rare):
            own = {} if own is None else {r["word"]: (np.asarray(r["vec"], float) if r["known"] else None, r["known"], r["unknown"]) for r in own}
            if not hyp.split():
                out.append([0.0] * len(names))
                continue
            side = entries(hyp, places, matrix, own, unknown)
            found = [entries(r, places, matrix, own, unknown) for r in many if r.split()]
            out.append([max((MEASURES[n](*side, *f) for f in found), key=lambda x: (np.isnan(x), x), default=0.0) for n in names])
        return pd.DataFrame(out, columns=list(names), dtype="float64")

    return score


def head_words(table: DataFrame, n: int) -> tuple[tuple[dict, np.ndarray], DataFrame | None]:
    """The ``n`` most frequent words as places in a matrix, and the table of the others, if there are any."""
    head = table.orderBy(F.desc("cnt"), "word").limit(n).select("word", "vec", "known", "unknown", "cnt").collect()  # bounded
    vecs = [np.asarray(r["vec"], dtype=float) for r in head if r["known"]]
    matrix = np.stack(vecs) if vecs else np.zeros((0, 0))
    places, at = {}, 0
    for r in head:
        places[r["word"]] = (at, r["known"], r["unknown"])
        at += r["known"] > 0
    if len(head) < n:
        return (places, matrix), None
    last = F.lit(head[-1]["cnt"])
    # the order above ends with nulls
    after = F.col("cnt").isNull() & last.isNotNull() | (F.col("cnt") < last) | (F.col("cnt").eqNullSafe(last) & (F.col("word") > head[-1]["word"]))
    return (places, matrix), table.filter(after)


def embedding_scores(pairs: DataFrame, vectors: DataFrame, names=tuple(MEASURES), wide_rows: int = WIDE_ROWS) -> DataFrame:
    """``pair_id`` and one column per measure: the best value over the references.

    ``vectors`` is ``word, vec, cnt`` with ``cnt`` the word's frequency. The ``wide_rows`` most frequent words travel once to every
    worker, the vectors of the others only to the pairs that have them; a pair is scored inside its row.
    """
    vectors = checkpointed(vectors)
    unknown = np.array(mean_vector(vectors), dtype=float)
    table = checkpointed(word_table(vectors))
    words, others = head_words(table, wide_rows)
    words = pairs.sparkSession.sparkContext.broadcast(words)
    laid = by_pair(pairs)
    sides = token_sides(laid, True)
    if others is None or others.isEmpty():
        sides = sides.withColumn("rare", F.lit(None).cast("array<struct<word:string,vec:array<double>,known:bigint,unknown:bigint>>"))
    else:
        sides = sides.join(rare_words(laid, others), "pair_id", "left")
    scored = sides.select("pair_id", "copies", _scorer(names, words, unknown)("hyp", "refs", "rare").alias("s"))
    own = [F.when(F.col("pair_id").isNull(), F.lit(0.0)).otherwise(F.coalesce(f"s.{n}", F.lit(0.0))).alias(n) for n in names]
    return scored.select("pair_id", *own, F.explode(F.transform("copies", lambda c: F.lit(True))).alias("_")).drop("_")
