"""Periodic runs of words: maximal stretches that repeat themselves, by suffix trees and Lyndon roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styleops.functions.text import let
from styleops.llm.common import small_batches, whole_text
from styleops.llm.suffix_tree import Extensions

#: A run has at least this many words, and two periods.
LEAST_WORDS = 12
#: Every run holds a gram of this many words twice, one period apart: a run of L words with period q has L - q >= 6.
GRAM = LEAST_WORDS // 2
#: Words handled at once, and words of one pair of trees; a longer text is handled alone.
BLOCK_WORDS = 500_000
TREE_WORDS = 60_000
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        made = self[word] = len(self)
        return made


def _repeated(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks the words of every gram that stands more than once in its stretch; digests that meet only add work."""
    inside = owner[GRAM - 1 :] == owner[: len(owner) - GRAM + 1]
    at = np.flatnonzero(inside)
    total = owner[at].astype(np.uint64) * _MIX
    for k in range(GRAM):
        total = (total ^ (total >> np.uint64(29))) * _FACTOR + words[at + k].astype(np.uint64)
    total = (total ^ (total >> np.uint64(32))) * _MIX
    order = np.argsort(total, kind="stable")
    same = total[order][1:] == total[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[at[twice]] += 1
    edges[at[twice] + GRAM] -= 1
    return np.cumsum(edges[:-1]) > 0


def stretches(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches that can hold a run, in order; ``owner`` numbers the text of each word.

    A run lies whole in words whose grams repeat within its own stretch, so what is left out holds no part of one.
    """
    place = np.arange(len(words))
    owner = owner.astype(np.int64)
    while len(place) >= LEAST_WORDS:
        kept = _repeated(words[place], owner)
        fresh = np.flatnonzero(kept)
        if len(fresh) == len(place):
            break
        place, owner = place[fresh], owner[fresh]
        breaks = np.ones(len(place), bool)
        breaks[1:] = (np.diff(place) != 1) | (np.diff(owner) != 0)
        owner = np.cumsum(breaks)
    if len(place) < LEAST_WORDS:
        return []
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    return [(a, b + 1) for a, b in zip(place[first].tolist(), place[last].tolist(), strict=True) if b + 1 - a >= LEAST_WORDS]


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one with a smaller rank, or the number of places."""
    out, waiting = [len(rank)] * len(rank), []
    for at, value in enumerate(rank):
        while waiting and rank[waiting[-1]] > value:
            out[waiting.pop()] = at
        waiting.append(at)
    return np.asarray(out, np.int64)


def find_runs(parts: list[np.ndarray], least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """For each sequence its runs ``(start, length, period)`` of at least ``least`` numbers, by start and period.

    All sequences stand in one text, each with an end mark of its own. For each of the two orders of the numbers, the longest
    Lyndon word from a place ends at the next smaller suffix. The root of every run is such a word in one of the orders;
    it is extended to both sides by common extensions in the trees of the text and of its reversal. In the second order, made by
    turning the ranks, end marks come last, so a word that ends there is no root; the run is found in the first one.
    """
    if not parts:
        return []
    marks = len(parts)
    values, numbers = np.unique(np.concatenate(parts), return_inverse=True)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    text = np.empty(ends[-1] + 1, np.int64)
    word = np.ones(len(text), bool)
    word[ends] = False
    text[word], text[ends] = numbers + marks, np.arange(marks)
    size, n = marks + len(values), len(text)
    ahead, back = Extensions(text.tolist(), size), Extensions(_turned(text).tolist(), size + 1)
    part = np.repeat(np.arange(marks), [len(p) + 1 for p in parts])
    place = np.flatnonzero(word)
    found = []
    for rank, to_end in ((ahead.rank, True), (n - 1 - ahead.rank, False)):
        root = _next_smaller(rank.tolist())[place]
        good = (root <= ends[part[place]]) if to_end else (root < ends[part[place]])
        i, j = place[good], root[good]
        right = ahead.of(i, j)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        left[inner] = back.of(n - i[inner], n - j[inner])
        period = j - i
        length = left + period + right
        run = (length >= 2 * period) & (length >= least)
        found.append(np.stack([i - left, length, period], axis=1)[run])
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    begins = ends - [len(p) for p in parts]
    for start, length, period in runs.tolist():
        k = int(part[start])
        out[k].append((start - int(begins[k]), length, period))
    return out


def _turned(text: np.ndarray) -> np.ndarray:
    """The reversed text with an end mark of its own, 0; place ``i`` of the text is place ``n - 1 - i`` here."""
    return np.append(text[::-1] + 1, 0)


def _solved(words: np.ndarray, bounds: list[tuple[int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each stretch; equal stretches are solved once."""
    known: dict[bytes, list[tuple[int, int, int]]] = {}
    keys = [words[a:b].tobytes() for a, b in bounds]
    held: list[bytes] = []
    size = 0
    fresh = list(dict.fromkeys(keys))
    for k, key in enumerate(fresh):
        held.append(key)
        size += len(key) // 8
        if size >= TREE_WORDS or k + 1 == len(fresh):
            found = find_runs([np.frombuffer(h, np.int64) for h in held])
            known.update(zip(held, found, strict=True))
            held, size = [], 0
    return map(known.__getitem__, keys)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    numbers = _Numbers()
    sizes = [len(t) for t in texts]
    words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, sum(sizes))
    begins = np.cumsum([0, *sizes])
    owner = np.repeat(np.arange(len(texts)), sizes)
    bounds = stretches(words, owner)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (a, _), found in zip(bounds, _solved(words, bounds), strict=True):
        text = int(owner[a])
        out[text] += [(a - int(begins[text]) + start, length, period) for start, length, period in found]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in no run after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    dropped = np.cumsum(edges[:-1]) > 0
    return [w for w, d in zip(words, dropped.tolist(), strict=True) if not d]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    Words are what ASCII white space parts. A run is a stretch of words with smallest period q, at least two periods
    and ``LEAST_WORDS`` words long, that no neighbouring word extends; ``runs`` holds all of them by start and period.
    ``collapsed`` is the words, joined by single blanks, without those that a run holds after its first q words.

    Each text is read whole in one task and no row is shuffled, so hot sources and copies cost nothing extra; equal
    stretches of a block are solved once. A null text counts as empty, and such texts have no words and no runs. Repeated and null ids
    are rows of their own; an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column("doc_id")
            texts = [t.split() for t in rows.column("norm").cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_WORDS):
                    size += len(texts[end])
                    end += 1
                part = texts[at:end]
                found = runs_of(part)
                collapsed = [b" ".join(collapse(w, r)) for w, r in zip(part, found, strict=True)]
                runs = [[{"start": a, "length": b, "period": c} for a, b, c in r] for r in found]
                arrays = [
                    ids[at:end], pa.array([len(w) for w in part], pa.int64()),
                    pa.array(runs, pa.list_(RUN)), pa.array(collapsed, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("norm")).mapInArrow(run, SCHEMA)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in rows with crc32(id) % 10 = 0 the words from a place on repeat themselves.

    With g = crc32 // 10 and n words, word i >= a becomes word a + (i - a) % p, for a = g % n and
    p = 1 + (n - a) // (3 + g % 8). Rows without words or id stay as they are.
    """
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    draw = F.floor(digest / 10).cast("long")
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def turned(found: Column) -> Column:
        n = F.size(found)
        first = (draw % n).cast("int")
        period = F.lit(1) + F.floor((n - first) / (3 + draw % 8)).cast("int")
        return let(
            F.struct(first.alias("a"), period.alias("p"), found.alias("w")),
            lambda s: F.array_join(
                F.transform(
                    F.sequence(F.lit(0), F.size(s["w"]) - 1),
                    lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])),
                ),
                " ",
            ),
        )

    made = let(words, lambda found: F.when(F.size(found) > 0, turned(found)))
    return docs.select("doc_id", F.when(digest % 10 == 0, F.coalesce(made, F.col("text"))).otherwise(F.col("text")).alias("text"))


def summary(found: DataFrame) -> DataFrame:
    """One line for each row of ``periodic_runs``: the longest run and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
