"""Tagging and encoding of lines as they arrive; both are stateless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from styleops.functions import text
from styleops.operators.tagging import tag_sentences
from styleops.operators.vocab import encode_ids, weighted
from styleops.session import checkpointed, scratch_path

Step = Callable[[DataFrame], DataFrame]


def stream_lines(spark: SparkSession, path: str, fmt: str = "text", schema: StructType | None = None, **options) -> DataFrame:
    """A stream of the files that arrive in a folder, or of one file."""
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def stream_tag(lexicon: DataFrame, seed: int = 0, **options) -> Step:
    """A step for batches ``row_id, txt, style, split``: tag them with a fixed lexicon of any size."""
    lexicon = checkpointed(lexicon)
    return lambda batch: tag_sentences(batch, lexicon, seed, **options)


def stream_prepare(vocab: DataFrame) -> Step:
    """A step for batches ``row_id, txt``: clean, append the end mark and encode by a vocabulary of any size."""
    vocab = weighted(vocab)
    return lambda batch: encode_ids(batch, "row_id", text.append_eos(text.clean_sentence(F.col("txt"))), vocab, "ids")


def run_available(stream: DataFrame, name: str, step: Step = lambda batch: batch) -> DataFrame:
    """Process all that has arrived, batch by batch, and read the result back.

    A batch is written to a folder of its number, so a repeated one replaces itself.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    schema = step(spark.createDataFrame([], stream.schema)).schema
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).select(*schema.names)
