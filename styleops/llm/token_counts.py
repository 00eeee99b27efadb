"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styleops.llm.chunks import count_words
from styleops.llm.common import small_batches, whole_text

CACHE = "content binary, tokenizer string, n_tokens long"
CONTEXT = 2048


def tokenizer_version(path: str) -> str:
    """The digest of the tokenizer's file: a changed file misses every stored count."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _counts(path: str, version: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n = count_words(path, rows["norm"].tolist())
            yield pd.DataFrame({"content": rows["content"], "tokenizer": version, "n_tokens": n})

    return run


def count_tokens(docs: DataFrame, path: str, cache: str, context: int = CONTEXT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, counts taken from or added to ``cache``.

    The tokenizer at ``path`` (a tokenizers file that drops white space) counts each distinct text
    that the cache, a parquet folder, does not know under this tokenizer's digest; the new counts
    are appended. Texts are made distinct by digest before they are shuffled, so the copies of a
    hot text meet as one row for each task. Blanks at both ends are not content; null
    counts as empty (0 tokens). Every row of ``docs`` gives a row, repeated ids too; other columns are not
    read. Writers that append at the same time may store a content twice, which changes no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_version(path)
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(cache)
    norm = F.trim(whole_text())
    # rows of two writers at once may repeat a content; each counts once
    kept = lambda: spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    stored = lambda: kept().groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    texts = docs.select(digest_of(norm).alias("content"), norm.alias("norm")).dropDuplicates(["content"])
    misses = texts.join(kept().select("content"), "content", "left_anti")
    misses.mapInPandas(_counts(path, version), CACHE).write.mode("append").parquet(cache)
    rows = docs.select("doc_id", digest_of(norm).alias("content"), F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    return rows.join(stored(), "content", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > context).alias("over_limit")
    )
