"""Streams read a table that is one file or a folder of part files, with a vocabulary of any size."""

import shutil

import pytest
from pyspark.sql import functions as F

from styleops.operators import bpe
from styleops.plans import model_queries as M
from styleops.plans import views as V
from styleops.streaming import lines as ST


@pytest.fixture(params=[False, True])
def tables(request, spark, sf, tmp_path):
    """A copy of the tables whose documents are one file or a folder of five."""
    source = f"{sf}/documents.parquet"
    if request.param:
        spark.read.parquet(source).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        shutil.copy(source, tmp_path)
    return str(tmp_path)


def test_stream_reads_either_form(spark, tables):
    got = M.QUERIES["stream_lines"](spark, tables)
    assert got.exceptAll(V.lines(spark, tables)).count() == 0 and got.count() == V.lines(spark, tables).count()


def test_stream_encodes_with_a_large_vocabulary(spark, tables):
    vocab = spark.range(60_000).select(F.col("id").cast("int"), F.concat(F.lit("t"), "id").alias("token"), F.lit(1).cast("long").alias("cnt"))
    rows = M._stream_lines(spark, tables).select(F.col("doc_id").alias("row_id"), F.concat(F.lit("t59999 t7 t"), "doc_id").alias("txt"))
    out = {r.row_id: r.ids for r in ST.run_available(rows, "large", ST.stream_prepare(vocab)).collect()}
    assert len(out) == spark.read.parquet(f"{tables}/documents.parquet").count()
    assert all(ids[:3] == [59999, 7, k] for k, ids in out.items() if k > 10)


def test_merges_of_a_symbol_with_a_quotation_end(spark):
    df = spark.createDataFrame([(r"a\E b a\E",)], "symbols string")
    assert df.select(bpe.apply_merges(F.col("symbols"), [(r"a\E", "b")]).alias("x")).first().x == r"a\Eb a\E"
