"""Style lexicon: relative TF-IDF of two corpora, percentile rank, selection."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from styleops.functions import text
from styleops.operators import digests, scale
from styleops.operators.corpus import lexicon_input
from styleops.operators.ngrams import explode_ngrams
from styleops.session import checkpointed, written

RATIO_DIGITS = 9
#: Terms whose idf every worker holds, about a hundred megabytes, and terms that a worker sums up before it hands them on.
HELD_TERMS = 500_000
SUMMED_TERMS = 500_000
#: Cells handed from Python to Spark at once.
FLAT_CELLS = 50_000
#: Rows whose terms are looked up together, and rows for each part of all terms.
BLOCK_ROWS = 16_384
PART_ROWS = 16_384


def term_frequencies(corpus: DataFrame, low: int = 1, high: int = 2) -> DataFrame:
    """``style, row_id, term, tf``.

    The text is spread by row before it is exploded, so counting inside a row needs no second
    shuffle and the (much wider) n-gram rows stay where they are made.
    """
    rows = scale.spread(corpus.select("style", "row_id", "txt"), "row_id")
    return (
        explode_ngrams(rows, ["style", "row_id"], text.word_tokens(F.col("txt")), low, high)
        .groupBy("row_id", "style", F.col("gram").alias("term"))
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def ngram_counts(corpus: DataFrame, low: int = 1, high: int = 2) -> DataFrame:
    return (
        explode_ngrams(corpus, ["style"], text.word_tokens(F.col("txt")), low, high)
        .groupBy("style", F.col("gram").alias("term"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def doc_freq_idf(tf: DataFrame, corpus: DataFrame) -> DataFrame:
    """``style, term, freq, df, idf`` with idf = ln((1+N)/(1+df)) + 1; N counts every row."""
    sizes = corpus.groupBy("style").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = tf.groupBy("style", "term").agg(
        F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("df")
    )
    return scale.small_join(counts, sizes, ["style"]).select(
        "style", "term", "freq", "df", _idf(F.col("df")).alias("idf")
    )


def _idf(df: Column) -> Column:
    return F.log((1 + F.col("n_docs")) / (1 + df)) + 1


def tfidf_weights(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """``style, row_id, term, tf, idf, weight``: tf*idf, scaled to unit length in each row.

    ``idf`` should be written already. Terms of one row only, most of any vocabulary, all have the
    same idf, so only the others have to be looked up.
    """
    single = idf.filter("df = 1").groupBy("style").agg(F.max("idf").alias("single_idf"))
    common = idf.filter("df > 1").select("style", "term", "idf", "df")
    found = scale.lookup_join(tf, common, ["style", "term"], weight="df", how="left")
    known = scale.small_join(found, single, ["style"], "left").withColumn(
        "idf", F.coalesce("idf", "single_idf")
    )
    raw = F.col("tf") * F.col("idf")
    # a window over one row's terms: the layout by row is kept, so there is nothing to shuffle
    norm = F.sqrt(F.sum(raw * raw).over(W.partitionBy("row_id", "style")))
    return known.select("style", "row_id", "term", "tf", "idf", (raw / norm).alias("weight"))


def mean_tfidf(weights: DataFrame, corpus: DataFrame) -> DataFrame:
    """``style, term, freq, df, idf, mean_tfidf``.

    The mean is over all rows of the style; rows without the term count as zero.
    """
    sizes = corpus.groupBy("style").agg(F.count(F.lit(1)).alias("n_docs"))
    totals = weights.groupBy("style", "term").agg(
        F.sum("tf").alias("freq"),
        F.count(F.lit(1)).alias("df"),
        F.max("idf").alias("idf"),
        F.sum("weight").alias("total"),
    )
    mean = (F.col("total") / F.col("n_docs")).alias("mean_tfidf")
    return scale.small_join(totals, sizes, ["style"]).select("style", "term", "freq", "df", "idf", mean)


def row_words(corpus: DataFrame) -> DataFrame:
    """``row_id, style, n_rows, words``: the words of all rows of one id and style, joined by blanks, a line for each row."""
    words = F.array_join(text.word_tokens(F.col("txt")), " ")
    rows = scale.spread(corpus.select("style", "row_id", words.alias("words")), "row_id")
    lines = F.array_join(F.collect_list("words"), "\n")
    return rows.groupBy("row_id", "style").agg(F.count(F.lit(1)).alias("n_rows"), lines.alias("words"))


def terms_of(words: str, low: int, high: int) -> list[str]:
    """All n-grams of the lines of ``words``."""
    out = []
    for line in words.split("\n"):
        line = line.split()
        for n in range(low, high + 1):
            out += line if n == 1 else map(" ".join, zip(*[line[d:] for d in range(n)]))
    return out


def _doc_freqs(low: int, high: int):
    """``style, term, df``: the rows with a term, summed up over as many rows as fit."""

    def frame(held: dict[str, Counter]) -> Iterator[pd.DataFrame]:
        for style, counts in held.items():
            if counts:
                yield pd.DataFrame({"style": pd.Series([style] * len(counts), dtype=object), "term": list(counts), "df": list(counts.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for rows in batches:
            for style, words in zip(rows["style"], rows["words"]):
                counts = held.setdefault(style, Counter())
                counts.update(set(terms_of(words, low, high)))
                if len(counts) > SUMMED_TERMS:
                    yield from frame(held)
                    held = {}
        yield from frame(held)

    return run


def _far_cells(low: int, high: int, held):
    """``row_id, style, single_idf, term, tf`` of the terms whose idf the workers do not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(at: list[int], terms: list[str], tfs: list[int]) -> pa.RecordBatch:
            kept = [rows.column(c).take(pa.array(at, pa.int64())) for c in ("row_id", "style", "single_idf")]
            return pa.RecordBatch.from_arrays([*kept, pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["row_id", "style", "single_idf", "term", "tf"])

        for rows in batches:
            at, terms, tfs = [], [], []
            for k, (style, words) in enumerate(zip(rows.column("style").to_pylist(), rows.column("words").to_pylist())):
                known = held.value.get(style, {})
                for term, tf in Counter(terms_of(words, low, high)).items():
                    if term not in known:
                        at.append(k)
                        terms.append(term)
                        tfs.append(tf)
                if len(at) >= FLAT_CELLS:
                    yield made(at, terms, tfs)
                    at, terms, tfs = [], [], []
            yield made(at, terms, tfs)

    return run


def _shares(low: int, high: int, held, whole: bool):
    """``style, term, freq, df, share``: counts of a term and the sum of its tf over the norms of its rows.

    If the held terms are the ``whole`` of those in several rows, any other one has the idf of a single row.
    """

    def frame(sums: dict[str, tuple[Counter, Counter, dict]]) -> Iterator[pd.DataFrame]:
        for style, (freq, df, share) in sums.items():
            if freq:  # all three have the terms in the order in which they came
                cells = {"term": list(freq), "freq": list(freq.values()), "df": list(df.values()), "share": list(share.values())}
                yield pd.DataFrame({"style": pd.Series([style] * len(freq), dtype=object), **cells})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[Counter, Counter, dict]] = {}
        for rows in batches:
            for style, words, single, squares in zip(rows["style"], rows["words"], rows["single_idf"], rows["far_squares"]):
                if style not in sums:  # numbers only, as a container for each term would keep the collector busy
                    sums[style] = Counter(), Counter(), {}
                freq, df, share = sums[style]
                known, terms = held.value.get(style, {}), terms_of(words, low, high)
                tf, other = Counter(terms), single if whole else 0.0
                norm = math.sqrt(squares + sum([(n * known.get(t, other)) ** 2 for t, n in tf.items()]))
                freq.update(terms)
                df.update(tf.keys())
                for term, n in tf.items():
                    share[term] = share.get(term, 0.0) + n / norm
                if len(freq) > SUMMED_TERMS:
                    yield from frame(sums)
                    sums = {}
        yield from frame(sums)

    return run


def style_stats(corpus: DataFrame, low: int = 1, high: int = 2, held_terms: int | None = None) -> DataFrame:
    """Term statistics of each style of the corpus, as in ``mean_tfidf``.

    The words of a row are written once and its terms counted inside it, so the cells of rows and terms are neither
    written nor sorted. Each worker holds the idf of the ``held_terms`` most common terms; only a row's cells of rarer
    ones are shuffled to their idf, and one sum a row comes back. A term's weights have its idf in common, so the sum of
    tf over norm is all that is added up.
    """
    held_terms = HELD_TERMS if held_terms is None else held_terms
    rows = written(row_words(corpus))
    sizes = checkpointed(rows.groupBy("style").agg(F.sum("n_rows").alias("n_docs")))
    rows = scale.small_join(rows, sizes.select("style", _idf(F.lit(1)).alias("single_idf"), "n_docs"), ["style"])
    counts = rows.select("style", "words").mapInPandas(_doc_freqs(low, high), "style string, term string, df long")
    several = written(counts.groupBy("style", "term").agg(F.sum("df").alias("df")).filter("df > 1"))
    whole = scale.bounded(several, held_terms)
    head = F.lit(True) if whole else scale.most_common(several, held_terms, "df")
    known = scale.small_join(several, sizes, ["style"]).select("style", "term", _idf(F.col("df")).alias("idf"), "df")
    table: dict[str, dict[str, float]] = {}
    for style, part in known.filter(head).select("style", "term", "idf").toPandas().groupby("style"):
        table[style] = dict(zip(part["term"], part["idf"]))
    held = rows.sparkSession.sparkContext.broadcast(table)
    if whole:
        rows = rows.withColumn("far_squares", F.lit(0.0))
    else:
        kept = rows.select("row_id", "style", "single_idf", "words")
        key = rows.schema["row_id"].dataType.simpleString()
        far = kept.mapInArrow(_far_cells(low, high, held), f"row_id {key}, style string, single_idf double, term string, tf long")
        weight = F.col("tf") * F.coalesce("idf", "single_idf")
        squares = (
            far.join(known.filter(~head).select("style", "term", "idf"), ["style", "term"], "left")
            .groupBy(F.col("row_id").alias("_row"), F.col("style").alias("_style"))
            .agg(F.sum(weight * weight).alias("_squares"))
        )
        same = F.col("row_id").eqNullSafe(F.col("_row")) & F.col("style").eqNullSafe(F.col("_style"))
        rows = kept.join(squares, same, "left").withColumn("far_squares", F.coalesce("_squares", F.lit(0.0)))
    shares = rows.select("style", "words", "single_idf", "far_squares").mapInPandas(
        _shares(low, high, held, whole), "style string, term string, freq long, df long, share double"
    )
    return _mean_of_shares(shares, sizes)


class RowTerms:
    """The n-grams of some rows: a cell for each n-gram and row, sorted by both; an n-gram is a digest of 64 bits.

    ``grams`` has the different n-grams in order, ``df`` and ``freq`` how many rows have each and how often it occurs;
    ``of`` is the number of its n-gram for each cell. If n-grams are ``checked``, 32 bits of another digest tell them apart too.
    """

    def __init__(self, rows: list[str], low: int, high: int, checked: bool = False):
        self.words: list[str] = []
        lengths, of_row = [], []
        for at, words in enumerate(rows):
            for line in words.split("\n"):
                line = line.split()
                self.words += line
                lengths.append(len(line))
                of_row.append(at)
        tokens, others = digests.hashed(self.words), digests.hashed(self.words, 1) if checked else None
        line = np.repeat(np.arange(len(lengths)), lengths)
        code, codes, places, other, checks = tokens, [], [], others, []
        for n in range(1, high + 1):
            if n > 1:
                code = digests.mixed(code[: max(len(tokens) - n + 1, 0)], tokens[n - 1 :])
                other = digests.mixed(other[: len(code)], others[n - 1 :]) if checked else None
            if n >= low:
                places.append(np.flatnonzero(line[: len(code)] == line[n - 1 :]))
                codes.append(code[places[-1]])
                checks.append((other[places[-1]] >> np.uint64(32)).astype(np.uint32) if checked else np.zeros(len(codes[-1]), np.uint32))
        gram, place, check = map(np.concatenate, (codes, places, checks))
        size = np.repeat(np.arange(low, high + 1), [len(p) for p in places])
        # the rows of an n-gram keep their order
        order = np.lexsort((check, gram)) if checked else np.argsort(gram, kind="stable")
        gram, place, size, check = gram[order], place[order], size[order], check[order]
        row = np.asarray(of_row, np.int64)[line][place]
        cell = digests.starts(gram, check, row)
        self.row, self.tf = row[cell], np.diff(np.append(cell, len(row)))
        first = digests.starts(gram[cell], check[cell])
        self.df = np.diff(np.append(first, len(cell)))
        self.of = np.repeat(np.arange(len(first)), self.df)
        self.freq = np.add.reduceat(self.tf, first) if len(first) else self.tf
        at = cell[first]
        self.grams, self.checks, self.place, self.size = gram[at], check[at], place[at], size[at]

    def terms(self, wanted: np.ndarray) -> list[str]:
        """The texts of some of the n-grams."""
        spans = zip(self.place[wanted].tolist(), self.size[wanted].tolist())
        return [" ".join(self.words[p : p + n]) for p, n in spans]


def _block_terms(low: int, high: int, parts: int):
    """``part, block, grams, df, freq``: the n-grams of a block, as differences, its rows with each and how often it occurs there."""

    def run(rows: pa.Table) -> pa.Table:
        words = rows.column("words").to_pylist()
        found = [(t.grams, t.df, t.freq) for t in (RowTerms(words[c], low, high) for c in digests.chunks(words))]
        grams, df, freq = digests.summed(*map(np.concatenate, zip(*found)))
        at, out = digests.cuts(grams, parts), []
        for part in np.flatnonzero(np.diff(at)).tolist():
            here = slice(at[part], at[part + 1])
            counts = [digests.packed(x[here].astype(np.uint32)) for x in (df, freq)]
            out.append((part, digests.packed(np.diff(grams[here], prepend=np.uint64(0))), *counts))
        columns = [pa.array([x[k] for x in out], t) for k, t in enumerate([pa.int64(), *[pa.binary()] * 3])]
        block = pa.array([rows.column("block")[0].as_py()] * len(out), pa.int64())
        return pa.table([columns[0], block, *columns[1:]], ["part", "block", "grams", "df", "freq"])

    return run


def _shared_terms(min_freq: int):
    """``block, part, df, wanted``: how many rows of its style have each n-gram of a block, and whether both styles have it
    and one of them often enough for the report."""

    def run(rows: pa.Table) -> pa.Table:
        block = rows.column("block").to_numpy()
        grams = [np.cumsum(digests.unpacked(x, np.uint64), dtype=np.uint64) for x in rows.column("grams").to_pylist()]
        df, freq = ([digests.unpacked(x, np.uint32) for x in rows.column(c).to_pylist()] for c in ("df", "freq"))
        of_style = [np.flatnonzero(block % 2 == k).tolist() for k in (0, 1)]

        def joined(parts: list[np.ndarray], at: list[int]) -> np.ndarray:
            return np.concatenate([parts[0][:0], *[parts[k] for k in at]])

        known, totals, often, numbers = [], [], [], []
        for at in of_style:
            kinds, number = np.unique(joined(grams, at), return_inverse=True)
            known.append(kinds)
            numbers.append(number)
            totals.append(np.bincount(number, joined(df, at), len(kinds)).astype(np.uint32))
            often.append(np.bincount(number, joined(freq, at), len(kinds)))
        _, *both = np.intersect1d(*known, assume_unique=True, return_indices=True)
        hit = np.maximum(often[0][both[0]], often[1][both[1]]) >= min_freq
        out: dict[int, tuple[bytes, bytes]] = {}
        for k, at in enumerate(of_style):
            wanted = np.zeros(len(known[k]), bool)
            wanted[both[k][hit]] = True
            ends = np.cumsum([len(grams[j]) for j in at])
            for j, number in zip(at, np.split(numbers[k], ends[:-1]) if at else []):
                out[j] = digests.packed(totals[k][number]), np.packbits(wanted[number]).tobytes()
        found = [pa.array([out[j][x] for j in range(len(grams))], pa.binary()) for x in (0, 1)]
        return pa.table([rows.column("block"), rows.column("part"), *found], ["block", "part", "df", "wanted"])

    return run


def _block_shares(low: int, high: int, styles: tuple[str, str], n_docs: list[int]):
    """``style, term, freq, df, share`` of a block's wanted n-grams, as in ``_shares``, with the answers for all its n-grams."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        words = rows.column("words").to_pylist()
        if not words:
            return pa.table({c: pa.array([], t) for c, t in _SHARES})
        style = rows.column("block")[0].as_py() % 2
        by_part = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "df", "wanted"))))
        df = [digests.unpacked(x, np.uint32) for _, x, _ in by_part]
        wanted = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(d)) for d, (_, _, x) in zip(df, by_part)]
        df, wanted = np.concatenate([np.zeros(0, np.uint32), *df]), np.concatenate([np.zeros(0, np.uint8), *wanted])
        idf = np.log((1 + n_docs[style]) / (1 + df.astype(np.float64))) + 1
        terms = [RowTerms(words[c], low, high) for c in digests.chunks(words)]
        grams = np.unique(np.concatenate([t.grams for t in terms]))
        out = [[], [], [], []]
        for t in terms:
            at = np.searchsorted(grams, t.grams)
            weight = t.tf * idf[at][t.of]
            norm = np.sqrt(np.bincount(t.row, weight * weight))
            share = np.bincount(t.of, t.tf / norm[t.row], len(t.grams))
            hit = np.flatnonzero(wanted[at])
            for column, values in zip(out, (t.terms(hit), t.freq[hit].tolist(), t.df[hit].tolist(), share[hit].tolist())):
                column.extend(values)
        columns = [[styles[style]] * len(out[0]), *out]
        return pa.table({c: pa.array(x, t) for (c, t), x in zip(_SHARES, columns)})

    return run


_SHARES = [("style", pa.string()), ("term", pa.string()), ("freq", pa.int64()), ("df", pa.int64()), ("share", pa.float64())]


def shared_stats(corpus: DataFrame, styles: tuple[str, str], low: int = 1, high: int = 2, min_freq: int = 1) -> DataFrame:
    """``style_stats`` of the terms that both styles have, one of them ``min_freq`` times: all that a report can need.

    Terms are counted as digests of 64 bits in blocks of rows. Equal ones of all blocks meet in one of many parts of the digests, and
    each block is told how many rows have its terms and which of them both styles have. So the weights of a row have all
    its terms, but only the texts of shared terms are shuffled, and these are what the statistics are summed up by; a
    meeting of digests could only change the weight of a term in its rows.
    """
    block = F.floor(F.monotonically_increasing_id() / BLOCK_ROWS) * 2 + (F.col("style") == styles[1]).cast("long")
    rows = written(row_words(corpus.filter(F.col("style").isin(*styles))).withColumn("block", block))
    sizes = checkpointed(rows.groupBy("style").agg(F.sum("n_rows").alias("n_docs"), F.count(F.lit(1)).alias("n")))
    found = {r["style"]: r for r in sizes.collect()}
    n_docs = [found[s]["n_docs"] if s in found else 0 for s in styles]
    partitions = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(partitions, -(-sum(r["n"] for r in found.values()) // PART_ROWS))
    of_block = rows.select("block", "words").groupBy("block")
    asked = of_block.applyInArrow(_block_terms(low, high, parts), "part long, block long, grams binary, df binary, freq binary")
    answers = asked.groupBy("part").applyInArrow(_shared_terms(min_freq), "block long, part long, df binary, wanted binary")
    shares = of_block.cogroup(answers.groupBy("block")).applyInArrow(
        _block_shares(low, high, styles, n_docs), "style string, term string, freq long, df long, share double"
    )
    return _mean_of_shares(shares, sizes.select("style", "n_docs"))


def _mean_of_shares(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    # laid out by term, so that the two styles of a term need no further shuffle to meet
    totals = scale.spread(shares, "term").groupBy("style", "term").agg(F.sum("freq").alias("freq"), F.sum("df").alias("df"), F.sum("share").alias("share"))
    idf = _idf(F.col("df"))
    mean = (idf * F.col("share") / F.col("n_docs")).alias("mean_tfidf")
    return scale.small_join(totals, sizes, ["style"]).select("style", "term", "freq", "df", idf.alias("idf"), mean)


def class_report(stats: DataFrame, styles: tuple[str, str], min_freq: int = 2) -> DataFrame:
    """Terms that occur in both styles, once for each direction, main frequency >= min_freq.

    One aggregation by term puts the two styles side by side, so no self-join is needed.
    """
    a, b = styles

    def side(style: str):
        fields = F.struct("freq", F.col("mean_tfidf").alias("mean"), "idf")
        return F.max(F.when(F.col("style") == style, fields))

    def direction(main: str, rel: str, m, r):
        return F.struct(
            F.lit(main).alias("main_style"),
            F.lit(rel).alias("rel_style"),
            m["freq"].alias("freq"),
            m["mean"].alias("main_mean"),
            r["mean"].alias("rel_mean"),
            m["idf"].alias("main_idf"),
            r["idf"].alias("rel_idf"),
        )

    return (
        stats.filter(F.col("style").isin(a, b))
        .groupBy("term")
        .agg(side(a).alias("a"), side(b).alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(
            "term",
            F.explode(
                F.array(direction(a, b, F.col("a"), F.col("b")), direction(b, a, F.col("b"), F.col("a")))
            ).alias("d"),
        )
        .select("d.main_style", "d.rel_style", "term", "d.freq", "d.main_mean", "d.rel_mean", "d.main_idf", "d.rel_idf")
        .filter(F.col("freq") >= min_freq)
    )


def relative_ratio(report: DataFrame) -> DataFrame:
    ratio = F.round(F.col("main_mean") / F.col("rel_mean"), RATIO_DIGITS)
    return report.withColumn("ratio", ratio).withColumn("inv_ratio", 1 / F.col("ratio"))


def tag_probability(ratios: DataFrame) -> DataFrame:
    """p = (ratio / sum of ratios)^0.75, scaled to sum 1 per direction.

    The inner sum cancels out, so one total per direction is enough.
    """
    powered = F.pow(F.col("ratio"), F.lit(0.75))
    totals = ratios.groupBy("main_style").agg(F.sum(powered).alias("_total"))
    return (
        scale.small_join(ratios, totals, ["main_style"])
        .withColumn("prob", powered / F.col("_total"))
        .drop("_total")
    )


def pct_rank_average(rows: DataFrame, group: str, value: str, tiebreak: str) -> DataFrame:
    """Ascending rank with ties averaged, divided by the group's size.

    Places come from a distributed ordering; a tie's rank is the middle of its first and last place.
    """
    placed = scale.ordered_index(rows, [F.col(value), F.col(tiebreak)], "_at", [group], start=1)
    ties = checkpointed(
        placed.groupBy(group, value).agg(
            ((F.min("_at") + F.max("_at")) / 2).alias("_mid"), F.count(F.lit(1)).alias("_n")
        )
    )
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    ranked = scale.lookup_join(placed, ties, [group, value], weight="_n")
    return (
        scale.small_join(ranked, sizes, [group])
        .withColumn("rank", F.col("_mid") / F.col("_size"))
        .drop("_at", "_mid", "_size")
    )


def lexicon_select(ranked: DataFrame, thresh: float = 0.90) -> DataFrame:
    if not thresh < 1:
        raise ValueError("thresh has to be below 1")
    score = (F.col("rank") - thresh) / (1 - F.lit(thresh))
    return ranked.filter(F.col("rank") >= thresh).withColumn("score", score)


def lexicon_ignore(lexicon: DataFrame, ignored: Iterable[str], main_style: str) -> DataFrame:
    """Drop a phrase of ``main_style`` if any of its words is in ``ignored``."""
    hit = F.arrays_overlap(F.split("term", " "), F.array(*[F.lit(w) for w in sorted(ignored)]))
    return lexicon.filter(~((F.col("main_style") == main_style) & hit))


def build_report(
    corpus: DataFrame,
    styles: tuple[str, str],
    ngram_range: tuple[int, int] = (1, 2),
    min_freq: int = 2,
) -> DataFrame:
    """The full comparison of the two styles, with ratio, probability and rank."""
    stats = shared_stats(lexicon_input(corpus), styles, *ngram_range, min_freq)
    ratios = relative_ratio(class_report(stats, styles, min_freq))
    return pct_rank_average(tag_probability(checkpointed(ratios)), "main_style", "ratio", "term")


def build_lexicon(
    corpus: DataFrame,
    styles: tuple[str, str],
    ngram_range: tuple[int, int] = (1, 2),
    min_freq: int = 2,
    thresh: float = 0.90,
    ignored: Iterable[str] | None = None,
) -> DataFrame:
    """``main_style, term, freq, ratio, prob, rank, score`` for both directions.

    ``ignored`` words apply to the first style only.
    """
    lexicon = lexicon_select(build_report(corpus, styles, ngram_range, min_freq), thresh)
    if ignored is not None:
        lexicon = lexicon_ignore(lexicon, ignored, styles[0])
    return lexicon.select("main_style", "term", "freq", "ratio", "prob", "rank", "score")
