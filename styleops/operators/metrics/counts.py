"""n-gram counts per pair and side, the base of the overlap metrics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styleops.functions import text
from styleops.operators import scale

ORDER = 4
HYP = -1
#: Rows handed from Python to Spark at once.
FLAT_ROWS = 50_000


def by_pair(pairs: DataFrame) -> DataFrame:
    """Lay pairs out by ``pair_id``: the one shuffle; all work inside a pair then stays local."""
    return scale.spread(pairs.select("pair_id", "hyp", "refs"), "pair_id")


def gathered(pairs: DataFrame) -> DataFrame:
    """``pair_id, copies``: all rows of each ``pair_id``; ``pairs`` should be laid out by ``by_pair``."""
    return pairs.groupBy("pair_id").agg(F.collect_list(F.struct("hyp", "refs")).alias("copies"))


def token_sides(pairs: DataFrame, whole_text: bool = False) -> DataFrame:
    """``pair_id, copies, hyp, refs``: one row for each ``pair_id`` with all its rows, and the texts of each of its sides.

    The tokens of a text are joined by blanks, the texts of a side by line breaks. With ``whole_text`` a text only has no line
    breaks, for readers that split it themselves. A row without references counts for
    nothing. ``pairs`` should be laid out by ``by_pair``. All n-grams of a pair are then counted inside its row, so
    neither an aggregation nor a sort ever holds exploded n-grams.
    """
    whole = F.filter("copies", lambda c: c["refs"].isNotNull())
    n_refs = F.coalesce(F.array_max(F.transform(whole, lambda c: F.size(c["refs"]))), F.lit(0))
    numbers = F.when(n_refs > 0, F.sequence(F.lit(0), n_refs - 1)).otherwise(F.array().cast("array<int>"))

    def line(txt: Column) -> Column:
        return F.replace(txt, F.lit("\n"), F.lit(" ")) if whole_text else F.array_join(text.ws_tokens(txt), " ")

    def side(texts: Column) -> Column:
        return F.array_join(F.transform(texts, line), "\n")

    both = F.struct(
        side(F.transform(whole, lambda c: c["hyp"])).alias("hyp"),
        F.transform(numbers, lambda r: side(F.transform(whole, lambda c: F.get(c["refs"], r)))).alias("refs"),
    )
    # exploded, the sides are columns of their own, which can be handed to Python; as nested lambdas they could not
    return gathered(pairs).select("pair_id", "copies", F.explode(F.array(both)).alias("s")).select("pair_id", "copies", "s.hyp", "s.refs")


def grams(lines: Iterable[list[str]], n: int) -> Counter:
    """How often each n-gram, a tuple of tokens, occurs in some lists of tokens."""
    found = Counter()
    for tokens in lines:
        found.update(zip(*[tokens[d:] for d in range(n)]))
    return found


def side_grams(side: str, n: int) -> Counter:
    """How often each n-gram, a tuple of tokens, occurs in a side."""
    return grams((line.split() for line in side.split("\n")), n)


def flat_rows(sides: DataFrame, rows: Callable[[str, list[str]], Iterable[tuple]], schema: str) -> DataFrame:
    """``pair_id`` and the columns of ``schema``: all rows that ``rows`` gives for the sides of each pair."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    key = sides.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, out = [], []

        def made() -> pd.DataFrame:
            return pd.DataFrame({"pair_id": pd.Series(ids, dtype=object), **dict(zip(names, zip(*out)))})

        for batch in batches:
            for pair_id, hyp, refs in zip(batch["pair_id"].astype(object).where(batch["pair_id"].notna(), None), batch["hyp"], batch["refs"]):
                before = len(out)
                out.extend(rows(hyp, refs))
                ids.extend([pair_id] * (len(out) - before))
                if len(out) >= FLAT_ROWS:
                    yield made()
                    ids, out = [], []
        if out:
            yield made()

    # a null among whole numbers would turn them into floats, so ids travel as text
    texts = sides.select(F.col("pair_id").cast("string").alias("pair_id"), "hyp", "refs")
    return texts.mapInPandas(run, f"pair_id string, {schema}").withColumn("pair_id", F.col("pair_id").cast(key))


def metric_ngrams(pairs: DataFrame, high: int = ORDER) -> DataFrame:
    """``pair_id, ref_no, n, gram, cnt``; ``pairs`` should be laid out by ``by_pair``."""

    def counted(hyp: str, refs: list[str]) -> Iterator[tuple]:
        for ref_no, side in enumerate([hyp, *refs], HYP):
            for n in range(1, high + 1):
                for gram, cnt in side_grams(side, n).items():
                    yield ref_no, n, " ".join(gram), cnt

    return flat_rows(token_sides(pairs, True), counted, "ref_no int, n int, gram string, cnt long")


def fold_case(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"hyp": F.lower("hyp"), "refs": F.transform("refs", F.lower)})


def n_tokens(txt: Column) -> Column:
    return F.size(text.ws_tokens(txt)).cast("long")
