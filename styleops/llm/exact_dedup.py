"""Exact dedup by content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from styleops.llm.common import as_row, ascii_lower, narrow, partitions, regrouped, row_columns, whole_text, written

PREFIX = 24
#: A content is split if it has more rows than this and than a quarter of an even partition; so few can be so hot.
HOT_ROWS = 1000
SHARE = 4


def hot_contents(keyed: DataFrame, rows: int) -> DataFrame:
    """``hash, splits`` of the contents with too many rows for one partition, at most ``SHARE`` for each partition."""
    most = max(HOT_ROWS, rows // (SHARE * partitions(keyed.sparkSession)))
    counts = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > most).select("hash", F.ceil(F.col("n") / most).cast("int").alias("splits"))


def content_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run_keep, run_size, text_sha256, head`` of every row: the largest id and the size of its run of equal neighbours.

    ``head`` is the text of the first row of a run whose content was split, else null.
    """
    keyed = docs.select("doc_id", ascii_lower(whole_text()).alias("norm")).select(
        "doc_id", "norm", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("hash")
    )
    hot = written(narrow(hot_contents(keyed, docs.count())), "hot-contents")
    dealt = keyed.join(F.broadcast(hot), "hash", "left")
    split = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("splits")), F.lit(0)).cast("int")
    placed = dealt.withColumn("split", split).repartitionByRange("prefix", "hash", "split")
    near = W.partitionBy("prefix", "hash", "split").orderBy("norm", F.desc_nulls_last("doc_id"))
    before = F.lag("norm").over(near)
    begins = before.isNull() | (before != F.col("norm"))
    runs = placed.withColumn("begins", begins).select(
        "prefix", "hash", "split", "doc_id",
        F.sum(F.col("begins").cast("int")).over(near).alias("run"),
        F.when(F.col("begins") & F.col("splits").isNotNull(), F.col("norm")).alias("head"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    same = W.partitionBy("prefix", "hash", "split", "run")
    return runs.select("doc_id", F.max("doc_id").over(same).alias("run_keep"), F.count(F.lit(1)).over(same).alias("run_size"), "text_sha256", "head")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Normalised texts (A-Z lower-cased, null as empty) are range-partitioned by sampled splitters of (first characters, hash) and sorted
    inside each partition, which places equal texts next to each other; a text starts a new run where it differs, in full, from its
    neighbour, and the run is the group. The splitters are sampled from keys of bounded length, never from whole texts. A
    first count finds the few contents with too many rows for one partition; those are split by their ids as well, and the runs that this
    gives are joined by comparing the full texts of their heads.

    The largest ``doc_id`` of a group stays. ``keep_id`` is null only if all ids of the group are, and such rows are not kept, except
    that one text without any id has no row to keep. Rows that repeat an id count in ``group_size`` and share its
    decision. Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    rows = written(regrouped(content_runs(docs)), "content-runs")
    heads = rows.filter(F.col("head").isNotNull()).groupBy("head").agg(F.max("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"))
    heads = heads.select(F.sha2("head", 256).alias("text_sha256"), "all_keep", "all_size", F.lit(True).alias("hot"))
    keep = F.when(F.col("hot"), F.col("all_keep")).otherwise(F.col("run_keep"))
    found = rows.drop("head").join(F.broadcast(heads), "text_sha256", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        "text_sha256",
    )
    return narrow(found)


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each normalised text; all columns stay.

    It is a row with the largest id of the text, or with a null id if the text has no other. Of several such rows the
    smallest stays, by its text and then its other columns as JSON.
    """
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id")).cast("long")
    contents = exact_groups(docs).groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum(mine).alias("rows"))
    contents = written(narrow(contents), "contents")
    text = whole_text()
    keyed = docs.select(as_row(docs).alias("row"), F.col("doc_id").alias("id"), text.alias("whole"), F.sha2(ascii_lower(text), 256).alias("digest"))

    def candidates(rows):
        same = (F.col("digest") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("keep_id"))
        return keyed.join(contents.filter(rows), same, "left_semi")

    order = F.struct("whole", F.to_json("row"))
    several = candidates("rows > 1").groupBy("digest").agg(F.min_by("row", order).alias("row"))
    kept = candidates("rows = 1").select("row").unionByName(several.select("row"))
    return kept.select(*row_columns(docs, "row"))
