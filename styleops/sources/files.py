"""Readers and writers of the file forms: corpus, lines, references, lexicon, vectors, pairs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from styleops.functions import text
from styleops.operators import scale
from styleops.session import checkpointed

LEXICON_LINE = 1_000


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Number the rows of a file scan in reading order: file, place of the block, place in the block.

    Only one small row per file block is gathered; the lines themselves are not shuffled.
    """
    cols = rows.columns
    placed = rows.select(
        *cols,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    blocks = placed.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_mid").alias("_first")
    )
    blocks = checkpointed(
        scale.ordered_index(blocks, [F.col("_file"), F.col("_block")], "_at").withColumnsRenamed(
            {"_file": "_f", "_block": "_b"}
        )
    )
    starts = _starts(blocks)
    small = F.broadcast(starts) if scale.bounded(starts) else starts
    match = (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b"))
    number = F.col("_start") + F.col("_mid") - F.col("_first")
    return placed.join(small, match).select(number.alias(name), *cols)


def _starts(blocks: DataFrame) -> DataFrame:
    """Rows before each block: sums over groups of a thousand blocks, then inside each group."""
    grouped = blocks.withColumn("_g", F.floor(F.col("_at") / 1_000))
    upto = (W.unboundedPreceding, -1)
    before = grouped.groupBy("_g").agg(F.sum("_rows").alias("_sum")).select(
        "_g", F.coalesce(F.sum("_sum").over(W.orderBy("_g").rowsBetween(*upto)), F.lit(0)).alias("_base")
    )
    inside = F.sum("_rows").over(W.partitionBy("_g").orderBy("_at").rowsBetween(*upto))
    return grouped.join(before, "_g").select(
        "_f", "_b", "_first", (F.col("_base") + F.coalesce(inside, F.lit(0))).alias("_start")
    )


def read_corpus(spark: SparkSession, path: str, label_col: str = "style", multi_line: bool = False) -> DataFrame:
    """A tab-separated corpus with header ``txt, <label>, split``; doubled quotes inside fields.

    With ``multi_line`` quoted fields may hold line breaks; each file is then read by one task.
    """
    form = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    header = spark.read.csv(path, **form).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.csv(path, schema=schema, **form)
    return _numbered(rows, "row_id").select("row_id", "txt", F.col(label_col).alias("style"), "split")


def read_lines(spark: SparkSession, path: str | list[str], both_sides: bool = False) -> DataFrame:
    """``line_no, txt`` of a text file (gzip too), stripped on the right or on both sides."""
    clean = text.strip if both_sides else text.rstrip
    lines = _numbered(spark.read.text(path), "line_no")
    return lines.select("line_no", clean(F.col("value")).alias("txt"))


def read_pairs(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Join two line files by number; both need the same number of lines."""
    if src.count() != tgt.count():
        raise ValueError("source and target have different numbers of lines")
    return src.select("line_no", F.col("txt").alias("src")).join(
        tgt.select("line_no", F.col("txt").alias("tgt")), "line_no"
    )


def read_refs(references: list[DataFrame], hyps: DataFrame | None = None) -> DataFrame:
    """``pair_id, refs``: n line files side by side, as long as the shortest one.

    With ``hyps`` (line_no, txt) the counts have to agree and the result has ``hyp`` too.
    """
    numbered = [
        df.select("line_no", F.lit(i).alias("ref_no"), "txt") for i, df in enumerate(references)
    ]
    refs = (
        reduce(DataFrame.unionByName, numbered)
        .groupBy("line_no")
        .agg(F.sort_array(F.collect_list(F.struct("ref_no", "txt"))).alias("r"))
        .filter(F.size("r") == len(references))
        .select(F.col("line_no").alias("pair_id"), F.col("r.txt").alias("refs"))
    )
    if hyps is None:
        return refs
    if hyps.count() != refs.count():
        raise ValueError("hypotheses and references have different numbers of lines")
    return refs.join(hyps.select(F.col("line_no").alias("pair_id"), F.col("txt").alias("hyp")), "pair_id")


def discover_refs(spark: SparkSession, stem: str) -> list[str]:
    """Paths of ``stem0, stem1, ...`` and ``stem`` itself, or of the same with ``.ref`` added."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stem)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(stem + "*")) or []
    names = {str(s.getPath().getName()): str(s.getPath()) for s in found}
    base = path.getName()

    def having(name: str) -> str | None:
        return names.get(name) or names.get(name + ".gz")

    if having(base) is None and having(base + "0") is None and having(base + ".ref0"):
        base += ".ref"
    numbers = sorted(
        int(m[1]) for n in names if (m := re.fullmatch(re.escape(base) + r"(\d+)(?:\.gz)?", n))
    )
    paths = []
    for expected, number in enumerate(numbers):
        if number != expected:
            break
        paths.append(having(f"{base}{number}"))
    if having(base):
        paths.append(having(base))
    if not paths:
        raise FileNotFoundError(f"no reference file {stem}")
    return paths


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """One JSON object of phrases and scores per line and style, a thousand phrases each."""
    numbered = scale.ordered_index(
        lexicon.select("main_style", "term", "score"), [F.desc("score"), F.col("term")], "at", ["main_style"]
    )
    entry = F.struct(F.col("term").alias("key"), F.col("score").alias("value"))
    (
        numbered.groupBy("main_style", F.floor(F.col("at") / LEXICON_LINE).alias("part"))
        .agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))
        .select("main_style", "value")
        .write.mode("errorifexists")
        .partitionBy("main_style")
        .text(path)
    )


def read_lexicon(spark: SparkSession, path: str, style: str | None = None) -> DataFrame:
    """``main_style, term, score`` from JSON objects, written by ``write_lexicon`` or one per file."""
    rows = spark.read.text(path)
    label = F.lit(style) if style is not None else F.col("main_style").cast("string")
    scores = F.from_json("value", "map<string,double>")
    return rows.select(label.alias("main_style"), F.explode(scores).alias("term", "score"))


def write_split_files(tagged: DataFrame, path: str) -> None:
    """Originals and tagged texts side by side, one folder per split and style."""
    tagged.select("row_id", "orig", "tagged", "split", "style").write.mode("errorifexists").partitionBy(
        "split", "style"
    ).parquet(path)


def write_parallel(pairs: DataFrame, path: str) -> None:
    """Training pairs, one folder per target and split, in (style, row) order inside each file."""
    (
        pairs.repartitionByRange("target", "split", "style_ord", "pair_id")
        .sortWithinPartitions("target", "split", "style_ord", "pair_id")
        .write.mode("errorifexists")
        .partitionBy("target", "split")
        .parquet(path)
    )


def write_aligned(rows: DataFrame, order: Sequence[Column], sides: Sequence[str], path: str) -> None:
    """Line-aligned text, the form a trainer reads: one folder for each side, line k of each from the k-th row.

    ``order`` has to be a total order. Line breaks inside a text become a blank, a null an empty line.
    """
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*sides))
    for side in sides:
        line = F.regexp_replace(F.coalesce(side, F.lit("")), "[\r\n]+", " ")
        placed.select(line.alias("value")).write.mode("errorifexists").text(f"{path}/{side}")


def vector_columns(line: Column) -> list[Column]:
    parts = text.ws_tokens(line)
    vec = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("double"))
    return [F.get(parts, F.lit(0)).alias("word"), vec.alias("vec")]


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, word, vec`` from text rows ``word f f f ...``."""
    lines = read_lines(spark, path, both_sides=True).filter(F.col("txt") != "")
    return lines.select("line_no", *vector_columns(F.col("txt")))
