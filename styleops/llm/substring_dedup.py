"""Substring dedup: repeated lines, sentences and runs of 50 words lose all but their earliest occurrence."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from styleops.llm.common import as_row, blob, row_columns, steps_blob, steps_unblob, total_bytes, unblob, whole_text

#: A run of repeated units is removed if it has at least this many words.
LEAST_WORDS = 25
#: Bytes of text in one cell of documents, and of all text for one bucket of digests.
CELL_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 64
#: A unit ends after a line break, or after closing marks that white space follows.
UNIT_END = re.compile(r"\n\s*|[.!?]+\s+")
KEY = np.dtype([("high", "<u8"), ("low", "<u8")])
#: Any run of this many words that occurs again is removed, wherever it starts and ends.
WINDOW = 50
#: Words of the grams by which equal windows are found, and how many of them a window holds.
GRAM = 25
GRAMS = WINDOW - GRAM + 1
#: Scripts without blanks between words; each of their characters counts as a word of a window.
_WIDE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
WIDE = re.compile(f"[{_WIDE}]")
WORDS = re.compile(f"[{_WIDE}]|[^ \t\n\r\x0b\x0c{_WIDE}]+")
_PLAIN = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Odd factors of the rolling digests; a fixed choice.
_FACTORS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_TYPE = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
_CUT = [StructField("text", StringType()), StructField("removed", _SPANS_TYPE)]
_NULL_ID = np.iinfo(np.int64).max


def units(text: str) -> tuple[list[int], list[int], list[bytes]]:
    """Ends, word counts and digests of a text's units; they follow each other without gaps.

    A unit is a line, or a sentence of a line, with the white space after it. Digests are 128 bits of the
    lower-cased words joined by single blanks.
    """
    ends = [m.end() for m in UNIT_END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    words, digests, at = [], [], 0
    for end in ends:
        found = text[at:end].lower().encode("utf-8", "replace").split()
        words.append(len(found))
        digests.append(xxhash.xxh3_128_digest(b" ".join(found)))
        at = end
    return ends, words, digests


def _rolled(values: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomial digests of all runs of ``width`` values, modulo 2^64."""
    n = len(values)
    power = np.cumprod(np.full(n, factor, dtype=np.uint64))
    back = np.cumprod(np.full(n, pow(factor, -1, 1 << 64), dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power)])
    return (total[width:] - total[:-width]) * back[: n - width + 1]


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    span = 1
    while 2 * span <= width:
        values, span = pick(values[:-span], values[span:]), 2 * span
    return pick(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


class Windows:
    """All runs of ``WINDOW`` words of a cell's texts, by digests of the lower-cased words.

    ``least`` is the smallest gram digest of each window, which equal windows share; ``anchors`` are
    the gram digests that are the smallest of a window, once for each place. ``keys`` are digests of 128 bits
    and ``places`` the window's text and first word, as text << 32 | word.
    """

    def __init__(self, texts: list[str], anchors: bool = True, keys: bool = True):
        parts, sizes = [], []
        for text in texts:
            if WIDE.search(text):
                found = [w.lower().encode("utf-8", "replace") for w in WORDS.findall(text)]
            else:
                found = text.lower().encode("utf-8", "replace").split()
            if len(found) < WINDOW:
                found = []
            sizes.append(len(found))
            parts.append(b"".join(map(xxhash.xxh3_128_digest, found)))
        words = np.frombuffer(b"".join(parts), dtype="<u8").reshape(-1, 2)
        self.anchors = self.least = np.zeros(0, np.uint64)
        self.keys, self.places = np.zeros(0, KEY), np.zeros(0, np.int64)
        if not len(words):
            return
        text = np.repeat(np.arange(len(sizes)), sizes)
        word = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = text[: -WINDOW + 1] == text[WINDOW - 1 :]
        if anchors:
            self._by_grams(words, inside)
        if keys:
            self.keys = np.empty(int(inside.sum()), dtype=KEY)
            for k, (name, factor) in enumerate(zip(("high", "low"), _FACTORS, strict=True)):
                self.keys[name] = _rolled(words[:, k], WINDOW, factor)[inside]
            self.places = (text.astype(np.int64) << 32 | word)[: -WINDOW + 1][inside]

    def _by_grams(self, words: np.ndarray, inside: np.ndarray) -> None:
        grams = _rolled(words[:, 0], GRAM, _FACTORS[0])
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(_FACTORS[1])
        grams ^= grams >> np.uint64(29)
        least = _extreme(grams, GRAMS, np.minimum)
        edge = np.zeros(GRAMS - 1, np.uint64)
        top = _extreme(np.concatenate([edge, np.where(inside, least, np.uint64(0)), edge]), GRAMS, np.maximum)
        self.anchors, self.least = grams[top == grams], least[inside]


def _firsts(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, each with its smallest place and whether it has several."""
    order = np.lexsort((places, keys["high"], keys["low"]))
    keys, places = keys[order], places[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[at], places[at], np.diff([*at, len(keys)]) > 1


def _anchored(buckets: int):
    """One row for each bucket: the distinct anchors of a cell."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.unique(Windows(_ordered(rows)["norm"].tolist(), keys=False).anchors, return_counts=True)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        cell, out = int(rows["cell"].iloc[0]), []
        for b in np.unique(bucket).tolist():
            part = bucket == b
            out.append((b, cell, blob(keys[part], "<u8"), blob(counts[part] > 1, "u1")))
        return pd.DataFrame(out, columns=["bucket", "cell", "keys", "several"])

    return run


def _again(rows: pd.DataFrame) -> pd.DataFrame:
    """For each cell of a bucket, its anchors that occur more than once anywhere."""
    keys, several = unblob(rows["keys"], "<u8"), unblob(rows["several"], "u1") > 0
    cells = np.repeat(rows["cell"].to_numpy(np.int64), [len(x) // 8 for x in rows["keys"]])
    _, group, counts = np.unique(keys, return_inverse=True, return_counts=True)
    keep = ((counts > 1) | (np.bincount(group, weights=several) > 0))[group]
    keys, cells = keys[keep], cells[keep]
    out = [(c, blob(keys[cells == c], "<u8")) for c in np.unique(cells).tolist()]
    return pd.DataFrame(out, columns=["cell", "anchors"])


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of a cell in the order of their rank; null ids come last."""
    rows = rows.assign(_rank=[_NULL_ID if pd.isna(x) else int(x) for x in rows["doc_id"]])
    return rows.sort_values(["_rank", "norm"], kind="stable", ignore_index=True)


def _extract(buckets: int):
    """One row for each bucket: the distinct digests of a cell, each with its first place in the cell.

    Of the windows only those that share an anchor with another place are sent.
    """

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["bucket", "cell", "keys", "ranks", "places", "several"])
        if not len(rows):
            return empty
        rows = _ordered(rows)
        first: dict[bytes, list] = {}
        ranks, texts = rows["_rank"].tolist(), rows["norm"].tolist()
        for order, (rank, text) in enumerate(zip(ranks, texts, strict=True)):
            _, words, digests = units(text)
            for position, (n, digest) in enumerate(zip(words, digests, strict=True)):
                if not n:
                    continue
                if digest in first:
                    first[digest][2] = 1
                else:
                    first[digest] = [rank, order << 32 | position, 0]
        keys = np.frombuffer(b"".join(first), dtype=KEY)
        values = np.asarray(list(first.values()), dtype=np.int64).reshape(-1, 3)
        if len(anchors):
            found = Windows(texts)
            shared = np.isin(found.least, unblob(anchors["anchors"], "<u8"))
            more, places, several = _firsts(found.keys[shared], found.places[shared])
            keys = np.concatenate([keys, more])
            values = np.concatenate([values, np.stack([np.asarray(ranks, np.int64)[places >> 32], places, several], axis=1)])
        if not len(keys):
            return empty
        bucket = (keys["low"] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((values[:, 1], bucket))  # places, and with them ranks, rise
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        cell, out = int(rows["cell"].iloc[0]), []
        for b in np.unique(bucket).tolist():
            part = order[cuts[b] : cuts[b + 1]]
            out.append((b, cell, keys[part].tobytes(), steps_blob(values[part, 0]), steps_blob(values[part, 1]), blob(values[part, 2], "u1")))
        return pd.DataFrame(out, columns=empty.columns)

    return run


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    """For each cell of a bucket, its digests that occur more than once anywhere, with the earliest place."""
    keys, ranks, places = unblob(rows["keys"], KEY), steps_unblob(rows["ranks"]), steps_unblob(rows["places"])
    several = unblob(rows["several"], "u1") > 0
    cells = np.repeat(rows["cell"].to_numpy(np.int64), [len(x) // KEY.itemsize for x in rows["keys"]])
    order = np.lexsort((places, cells, ranks, keys["low"], keys["high"]))
    sorted_keys = keys[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    group = np.cumsum(fresh) - 1
    first = order[np.flatnonzero(fresh)]
    repeated = (np.bincount(group) > 1) | (np.bincount(group, weights=several[order]) > 0)
    keep = repeated[group]
    of, lead = order[keep], first[group[keep]]
    if not len(of):
        return pd.DataFrame(columns=["cell", "keys", "cells", "places"])
    by_cell = np.lexsort((places[lead], cells[lead], cells[of]))
    of, lead = of[by_cell], lead[by_cell]
    names, starts = np.unique(cells[of], return_index=True)
    out = []
    for name, part, head in zip(names.tolist(), np.split(of, starts[1:]), np.split(lead, starts[1:]), strict=True):
        out.append((name, keys[part].tobytes(), steps_blob(cells[head]), steps_blob(places[head])))
    return pd.DataFrame(out, columns=["cell", "keys", "cells", "places"])


def removed_spans(ends: list[int], words: list[int], repeated: list[bool], least: int) -> list[tuple[int, int]]:
    """The spans of the runs of repeated units (units without words don't break a run) that have ``least`` words."""
    spans, start, last, n, at = [], None, 0, 0, 0
    for end, w, again in zip([*ends, 0], [*words, 1], [*repeated, False], strict=True):
        if again and start is None:
            start, n = at, 0
        if start is not None and w:
            if again:
                last, n = end, n + w
            else:
                if n >= least:
                    spans.append((start, last))
                start = None
        at = end
    return spans


def _later(found: Windows, keys: np.ndarray, cells: np.ndarray, places: np.ndarray, cell: int) -> dict[int, list[tuple[int, int]]]:
    """For each text, the runs of words to cut, of windows that occur earlier; ``cells`` and ``places`` tell the earliest."""
    order = np.lexsort((keys["high"], keys["low"]))
    low, high = keys["low"][order], keys["high"][order]
    at = np.searchsorted(low, found.keys["low"])
    open_ = np.flatnonzero(at < len(low))
    hit = np.full(len(at), -1)
    while len(open_):  # more than once only if digests agree in one half
        open_ = open_[low[at[open_]] == found.keys["low"][open_]]
        same = high[at[open_]] == found.keys["high"][open_]
        hit[open_[same]] = order[at[open_[same]]]
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(low)]
    of = np.flatnonzero(hit >= 0)
    lead = hit[of]
    own, first = found.places[of], places[lead]
    # A run that overlaps its own earliest occurrence (words said over and over) leaves that whole.
    start = np.where((cells[lead] == cell) & (first >> 32 == own >> 32), np.maximum(own, first + WINDOW), own)
    later: dict[int, list[tuple[int, int]]] = {}
    for place, head, mine in zip(own.tolist(), start.tolist(), ((cells[lead] == cell) & (first == own)).tolist(), strict=True):
        if not mine:
            later.setdefault(place >> 32, []).append((head & 0xFFFFFFFF, (place & 0xFFFFFFFF) + WINDOW))
    return later


def word_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of runs of words (first, and one after the last), with the white space that follows, joined where they meet."""
    places = [m.start() for m in (WORDS if WIDE.search(text) else _PLAIN).finditer(text)] + [len(text)]
    spans: list[tuple[int, int]] = []
    for first, last in runs:
        if spans and places[first] <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], places[last])
        else:
            spans.append((places[first], places[last]))
    return spans


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _cut(least: int):
    def run(cell_rows: pa.Table, shared: pa.Table) -> pa.Table:
        found = shared.to_pandas()
        rows = cell_rows.select(["doc_id", "norm", "cell"]).to_pandas(integer_object_nulls=True)
        rows = _ordered(rows.assign(at=np.arange(len(rows))))
        keys = unblob(found["keys"], KEY)
        cells, places = steps_unblob(found["cells"]), steps_unblob(found["places"])
        cell = int(rows["cell"].iloc[0]) if len(rows) else 0
        norm = rows["norm"].tolist()
        later = _later(Windows(norm, anchors=False), keys, cells, places, cell) if len(keys) else {}
        is_unit = {}
        texts, spans = [], []
        all_units = [units(text) for text in norm]
        wanted = {d for _, words, digests in all_units for n, d in zip(words, digests, strict=True) if n}
        raw = keys.tobytes()
        for k in range(len(keys)):
            if (d := raw[16 * k : 16 * k + 16]) in wanted:
                is_unit[d] = int(cells[k]), int(places[k])
        for order, text in enumerate(norm):
            ends, words, digests = all_units[order]
            again = [n > 0 and d in is_unit and is_unit[d] != (cell, order << 32 | k) for k, (n, d) in enumerate(zip(words, digests, strict=True))]
            cut = removed_spans(ends, words, again, least) if any(again) else []
            if order in later:
                cut = _joined(cut + word_spans(text, later[order]))
            kept, at = [], 0
            for start, end in cut:
                kept.append(text[at:start])
                at = end
            texts.append("".join([*kept, text[at:]]))
            spans.append([{"start": a, "end": b} for a, b in cut])
        rest = cell_rows.column("rest").take(pa.array(rows["at"].to_numpy(np.int64)))
        return pa.table({"rest": rest, "text": pa.array(texts, pa.string()), "removed": pa.array(spans, SPANS)})

    return run


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``removed``: their spans in the original text.

    Units (lines, and sentences of lines) are equal if their lower-cased words are. Of each unit the
    occurrence with the smallest (doc_id, position) stays; null ids rank last, rows that repeat an
    id by their text. Of the others, a run of neighbouring ones is removed if it has
    ``least_words`` words together, with the white space that follows; shorter repeats, common
    headings for instance, stay. Besides, of each run of ``WINDOW`` words, wherever it starts and ends, only
    the earliest occurrence stays; overlapping ones of the others are removed as one span (of a run that overlaps its own
    earliest occurrence, what lies beyond that). In scripts without blanks a character counts as a word there. ``removed`` holds ``start`` and ``end`` in code points of the original text.

    Documents are dealt into cells of bounded size; a cell sends each of its distinct digests once, to
    a bucket that decides, and gets back those that repeat. Runs of words are sent only where they share
    their smallest gram with another place, which a first round over these grams finds. So a hot unit costs one entry for each
    cell. The text is shuffled once, by cell. Every row gives a row; a null text counts as empty, a wholly repeated one
    becomes empty. The other columns are carried as they are; a column ``removed`` is replaced.
    """
    size = total_bytes(docs)
    cells = max(16, -(-size // CELL_BYTES))
    buckets = max(LEAST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())
    left_out = ("text", "removed")
    norm = whole_text()
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        norm.alias("norm"),
        as_row(docs, *left_out).alias("rest"),
        F.pmod(F.xxhash64("doc_id", norm), F.lit(cells)).alias("cell"),
    )
    anchors = dealt.groupBy("cell").applyInPandas(_anchored(buckets), "bucket long, cell long, keys binary, several binary")
    shared = anchors.groupBy("bucket").applyInPandas(_again, "cell long, anchors binary")
    sent = (
        dealt.groupBy("cell")
        .cogroup(shared.groupBy("cell"))
        .applyInPandas(_extract(buckets), "bucket long, cell long, keys binary, ranks binary, places binary, several binary")
    )
    repeats = sent.groupBy("bucket").applyInPandas(_decide, "cell long, keys binary, cells binary, places binary")
    cut = (
        dealt.groupBy("cell")
        .cogroup(repeats.groupBy("cell"))
        .applyInArrow(_cut(least_words), StructType([dealt.schema["rest"], *_CUT]))
    )
    others = iter(row_columns(docs, "rest", *left_out))
    return cut.select(*[F.col("text") if c == "text" else next(others) for c in docs.columns if c != "removed"], "removed")
