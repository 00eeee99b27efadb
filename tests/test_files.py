import pytest
from pyspark.sql import functions as F

from styleops.sources import files

TSV = (
    "txt\tstyle\tsplit\n"
    "forwarded by\tP_2\ttrain\n"
    '"hello : please let me know if you have "" telerate "" ?"\tP_7\ttrain\n'
    "no style\t\ttest\n"
)


def test_corpus_with_doubled_quotes(spark, tmp_path):
    path = tmp_path / "corpus.tsv"
    path.write_text(TSV, encoding="utf-8")
    rows = files.read_corpus(spark, str(path)).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 1, 2]
    assert rows[1]["txt"] == 'hello : please let me know if you have " telerate " ?'
    assert rows[2]["style"] is None


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    for part in range(3):
        body = "".join(f"{part}-{i}  \n" for i in range(400))
        (tmp_path / f"part{part}.txt").write_text(body, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        rows = files.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["txt"] for r in rows] == [f"{p}-{i}" for p in range(3) for i in range(400)]
    assert [r["line_no"] for r in rows] == list(range(1200))


def test_pairs_need_equal_lengths(spark):
    a = spark.range(3).select(F.col("id").alias("line_no"), F.lit("x").alias("txt"))
    with pytest.raises(ValueError):
        files.read_pairs(a, a.limit(2))


def test_reference_file_rules(spark, tmp_path):
    for name in ("r0", "r1", "r3", "r"):
        (tmp_path / name).write_text("x\n")
    names = [p.rsplit("/", 1)[1] for p in files.discover_refs(spark, str(tmp_path / "r"))]
    assert names == ["r0", "r1", "r"]
    (tmp_path / "s.ref0").write_text("x\n")
    assert files.discover_refs(spark, str(tmp_path / "s"))[0].endswith("s.ref0")
    with pytest.raises(FileNotFoundError):
        files.discover_refs(spark, str(tmp_path / "none"))


def test_single_object_lexicon_is_read(spark, tmp_path):
    path = tmp_path / "P_9_tags.json"
    path.write_text('{"thank you": 0.5, "glad": 1.0}')
    rows = files.read_lexicon(spark, str(path), style="P_9").collect()
    assert {(r["main_style"], r["term"], r["score"]) for r in rows} == {("P_9", "thank you", 0.5), ("P_9", "glad", 1.0)}


def test_vector_file(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("a 1.0 2.5\nb -1 0\n")
    rows = files.read_vectors(spark, str(path)).orderBy("line_no").collect()
    assert [(r["word"], r["vec"]) for r in rows] == [("a", [1.0, 2.5]), ("b", [-1.0, 0.0])]


def test_corpus_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "corpus.tsv"
    path.write_text('txt\tstyle\tsplit\n"two\nlines"\tP_1\ttrain\none\tP_2\ttest\n', encoding="utf-8")
    rows = files.read_corpus(spark, str(path), multi_line=True).orderBy("row_id").collect()
    assert [(r["txt"], r["style"]) for r in rows] == [("two\nlines", "P_1"), ("one", "P_2")]


def test_aligned_files_come_back_as_pairs(spark, tmp_path):
    rows = [(k, f"source {k}" if k % 7 else None, f"target\n{k}" if k % 5 else "") for k in range(500)]
    table = spark.createDataFrame(rows, "k long, src string, tgt string").repartition(4)
    files.write_aligned(table, [F.col("k")], ["src", "tgt"], str(tmp_path / "out"))
    sides = [files.read_lines(spark, str(tmp_path / "out" / s)) for s in ("src", "tgt")]
    back = files.read_pairs(*sides).orderBy("line_no").collect()
    assert [tuple(r) for r in back] == [(k, a or "", b.replace("\n", " ")) for k, a, b in rows]


def test_unequal_counts_of_hypotheses_and_references(spark):
    lines = [spark.range(n).select(F.col("id").alias("line_no"), F.lit("x").alias("txt")) for n in (3, 4)]
    with pytest.raises(ValueError):
        files.read_refs(lines[:1], lines[1])
