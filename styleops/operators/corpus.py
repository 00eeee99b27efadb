"""Row filters and clean-up of a labelled corpus ``row_id, txt, style, split``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from styleops.functions import text


def filter_style(corpus: DataFrame, label: str) -> DataFrame:
    return corpus.filter(F.col("style") == label)


def style_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("style").agg(F.count(F.lit(1)).alias("n_rows"))


def filter_split(corpus: DataFrame, split: str) -> DataFrame:
    return corpus.filter(F.col("split") == split)


def lexicon_input(corpus: DataFrame) -> DataFrame:
    """All rows but the test split; a null split stays in."""
    return corpus.filter(~F.col("split").eqNullSafe("test") & F.col("txt").isNotNull())


def drop_duplicate_text(corpus: DataFrame) -> DataFrame:
    """Keep the first row of each text. A min over structs combines map-side, so a hot text is cheap."""
    rest = [c for c in corpus.columns if c not in ("txt", "row_id")]
    first = F.min(F.struct("row_id", *rest)).alias("first")
    return corpus.groupBy("txt").agg(first).select(
        "first.row_id", "txt", *[f"first.{c}" for c in rest]
    )


def contains_label(tagged: Column, label: Column | str) -> Column:
    return F.contains(tagged, label if isinstance(label, Column) else F.lit(label))


def keep_tagged(tagged: DataFrame) -> DataFrame:
    """Keep rows whose tagged text contains the style label anywhere."""
    return tagged.filter(contains_label(F.col("tagged"), F.col("style")))


def clean(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("txt").isNotNull()).withColumn(
        "txt", text.clean_sentence(F.col("txt"))
    )


def drop_consecutive_duplicates(batches: DataFrame, value: str, batch: list[str], pos: str) -> DataFrame:
    """Within a batch drop a value equal to the one just before it."""
    before = F.lag(value).over(W.partitionBy(*batch).orderBy(pos))
    return (
        batches.withColumn("_before", before)
        .filter(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull())
        .drop("_before")
    )
