"""Divergence of the sources of a language by their term shares, from texts counted once for all their copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from styleops.llm.common import narrow, partitions, small_batches, whole_text, written

#: A term is kept if so many documents of its language have it.
LEAST_DOCS = 30
#: Added to each count, and the scale of the shares.
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Words counted at once, and sums one worker holds before it hands them on.
BLOCK_WORDS = 1_000_000
HELD_SUMS = 1_500_000
#: Terms are runs of ASCII letters and of what lies beyond ASCII; A-Z are lower-cased.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SUMS = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        made = self[word] = len(self)
        return made


class Sums:
    """Occurrences and documents by group and term, added up as they come."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.terms = _Numbers()
        self.held = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, texts: list[tuple[list[bytes], str, list[tuple[str, int]]]]) -> None:
        """Texts as terms, language and the number of documents of each source."""
        words = np.fromiter((self.terms[t] for found, _, _ in texts for t in found), np.int64, sum(len(t[0]) for t in texts))
        owner = np.repeat(np.arange(len(texts)), [len(found) for found, _, _ in texts])
        pairs, n = np.unique(owner << 32 | words, return_counts=True)
        cells = [len(sources) for _, _, sources in texts]
        group = np.asarray([self.groups.setdefault((lang, s), len(self.groups)) for _, lang, sources in texts for s, _ in sources], np.int64)
        docs = np.asarray([k for _, _, sources in texts for _, k in sources], np.int64)
        owner, term = pairs >> 32, pairs & 0xFFFFFFFF
        times = np.asarray(cells, np.int64)[owner]
        first = (np.cumsum(cells) - cells)[owner]
        cell = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self._merge(group[cell] << 32 | np.repeat(term, times), np.repeat(n, times) * docs[cell], docs[cell])

    def _merge(self, *sums: np.ndarray) -> None:
        self.held = _summed(*(np.concatenate(p) for p in zip(self.held, sums, strict=True)))

    def out(self, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        keys, n, docs = self.held
        for at in range(0, len(keys), rows):
            part = keys[at : at + rows]
            group = pa.array(part >> 32)
            arrays = [
                langs.take(group), sources.take(group), terms.take(pa.array(part & 0xFFFFFFFF)),
                pa.array(n[at : at + rows]), pa.array(docs[at : at + rows]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])
        self.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, texts, size = Sums(), [], 0
    for rows in batches:
        cells = rows.column("cells").to_pylist()
        for text, lang, sources in zip(rows.column("norm").cast(pa.binary()).to_pylist(), rows.column("lang").to_pylist(), cells, strict=True):
            found = terms_of(text)
            texts.append((found, lang, [(c["source"], c["n"]) for c in sources]))
            size += len(found)
            if size >= BLOCK_WORDS:
                sums.add(texts)
                texts, size = [], 0
        if len(sums.held[0]) >= HELD_SUMS:
            yield from sums.out()
    if texts:
        sums.add(texts)
    yield from sums.out()


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms))``, in whole numbers of any size."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + PRIOR) * F.lit(SCALE), wide(total + terms * PRIOR))


def groups_of(docs: DataFrame) -> DataFrame:
    """``lang, digest, cells``: each distinct text with the number of documents of each source that have it."""
    per_source = docs.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    return per_source.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("cells"))


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, cells``: the kept terms of each language, ``cells`` holding ``source, n`` of the sources that have it.

    ``docs`` has ``lang, source, norm, digest``. A text is shuffled and split once for all documents of
    its language that hold it; the counts of its terms are then added to each source as often as it has the text. Workers add up by
    source and term before anything is sent, so a hot text, source or term is a few rows of each task.
    """
    texts = docs.select("lang", "digest", "norm").dropDuplicates(["lang", "digest"])
    collapsed = texts.join(groups_of(docs), ["lang", "digest"]).select("lang", "norm", "cells")
    # workers have added up what they can; laid out by term once, both sums need no further shuffle
    laid = collapsed.mapInArrow(_count, SUMS).repartition(partitions(docs.sparkSession), "lang", "term")
    sums = laid.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return kept.filter(F.col("docs") >= least_docs).select("lang", "term", "cells")


PARTS = "lang string, a string, b string, both long, shared long"


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of the values of each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For two sources, over the terms of a batch that both have: the sum of |p - q| - |p - base of b| - |q - base of a|, and their number.

    Only cells that exist are met: the cells of a term are compared with those 1, 2, ... places further in its list.
    """
    for rows in batches:
        cells = rows.column("cells")
        sizes = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(sizes) or sizes.max() < 2:
            continue
        flat = cells.flatten()
        source, p, base = (flat.field(k) for k in range(3))
        source = source.dictionary_encode()
        names, s = source.dictionary, source.indices.to_numpy().astype(np.int64)
        p, base = p.to_numpy().astype(np.int64), base.to_numpy().astype(np.int64)
        term = np.repeat(np.arange(len(sizes)), sizes)
        lang = rows.column("lang").dictionary_encode()
        lang_names, of = lang.dictionary, lang.indices.to_numpy().astype(np.int64)
        keys, gains, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, int(sizes.max())):
            first = np.flatnonzero(term[step:] == term[:-step])
            second = first + step
            gain = np.abs(p[first] - p[second]) - np.abs(p[first] - base[second]) - np.abs(p[second] - base[first])
            pair = (of[term[first]] * len(names) + s[first]) * len(names) + s[second]
            for held, part in zip((keys, gains, counts), _summed(pair, gain, np.ones(len(pair), np.int64)), strict=True):
                held.append(part)
        pair, gain, count = _summed(*(np.concatenate(x) for x in (keys, gains, counts)))
        arrays = [
            lang_names.take(pa.array(pair // len(names) ** 2)), names.take(pa.array(pair // len(names) % len(names))),
            names.take(pa.array(pair % len(names))), pa.array(gain), pa.array(count),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["lang", "a", "b", "both", "shared"])


def _pairs(groups: DataFrame, apart: DataFrame, both: DataFrame) -> DataFrame:
    """``lang, source, part, item, value`` for each source and each other one of its language."""
    h = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("own_h"), F.col("base").alias("base_h"))
    back = apart.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("far").alias("far_h"))
    met = groups.join(h, "lang").filter(F.col("source") != F.col("item"))
    for more in (apart, back, both):
        met = met.join(more, ["lang", "source", "item"], "left")
    met = met.na.fill(0, ["far", "far_h", "both", "shared"])
    neither = F.col("terms") - F.col("own") - F.col("own_h") + F.col("shared")
    value = neither * F.abs(F.col("base") - F.col("base_h")) + F.col("far") + F.col("far_h") + F.col("both")
    return met.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the sources of a language lie apart, and by which terms.

    Null texts, languages and sources count as empty. A term's share in a group (language and source) or in a whole language
    is ``share`` of its occurrences among those of all kept terms. Part ``pair``: for each other source of the language the sum
    of the absolute differences of shares over all kept terms. Part ``term``: of the terms a group has
    and that have a larger share there than in the language, the ``top`` with the largest difference. Ranks run from 1
    by falling value, equal values by item.

    The sum of a pair is put together from what each group has and what both have. With the share b of a
    term that a group lacks, the sum over all V terms of |p - q| is
    (V - terms of g or h) * |b_g - b_h| + D_g(b_h) + D_h(b_g) + a correction over the terms of both, where D_g(x) sums |p - x| over the
    terms of g. D comes from the few distinct counts of a group; only the correction looks at cells, in
    partial sums, so no row is made for a term and a pair.

    Copies, repeated and null ids are documents like any other; ids are not read. An empty table gives an empty
    result; a language without kept terms has values of 0 in ``pair`` and no ``term`` rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    base = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), whole_text().alias("norm"))
    base = base.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    kept = written(term_counts(base, least_docs), "kept-terms")
    cells = kept.select("lang", "term", F.explode("cells").alias("c")).select("lang", "term", "c.source", "c.n")
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    counted = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = base.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.na.fill(0, ["total", "own", "terms"])
    unseen = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(F.lit(0).cast("long"))
    groups = written(narrow(groups.withColumn("base", unseen)), "source-groups")

    # D_g(x) for the bases x of the other sources, from the distinct counts of g
    ladder = cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("many")).join(groups, ["lang", "source"])
    ladder = ladder.select("lang", "source", "many", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("x"))
    steps = ladder.join(other, "lang").filter(F.col("source") != F.col("item"))
    apart = steps.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("x")) * F.col("many")).alias("far"))

    sided = kept.select("lang", "term", F.explode("cells").alias("c")).select("lang", "term", "c.source", "c.n").join(groups, ["lang", "source"])
    entry = F.struct("source", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "base")
    lists = sided.groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("cells"))
    both = lists.select("lang", "cells").mapInArrow(_together, PARTS).groupBy("lang", "a", "b").agg(F.sum("both").alias("both"), F.sum("shared").alias("shared"))
    both = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), "both", "shared")
    both = both.select("lang", "p.source", "p.item", "both", "shared")
    pairs = _pairs(groups, apart, both)

    in_lang = cells.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    all_total = counted.groupBy("lang").agg(F.sum("total").alias("all_total"))
    shares = cells.join(in_lang, ["lang", "term"]).join(groups.join(all_total, "lang"), ["lang", "source"])
    value = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    terms = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).filter("value > 0")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
