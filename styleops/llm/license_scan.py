"""License scan: exact phrases, and short notices found with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleops.llm.common import small_batches, whole_text

#: Phrases whose words must stand consecutively, and their labels; fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that are also found with edits, and their labels.
NOTICES = {
    "this work is licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the bsd 3 clause license": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "under the terms of the eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
}
#: One edit is allowed for so many characters of a notice; at least one.
CHARS_PER_EDIT = 14
#: A code point has at most so many bytes, so an edit moves a place by at most so many.
_WIDEST = 4
#: Words are runs of digits, letters and what lies beyond ASCII; A-Z are lower-cased, the rest of ASCII parts words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])
SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("edits", pa.int64())])
SCHEMA = (
    "doc_id long, n_words long, places array<struct<label:string,word:long>>, "
    "spans array<struct<label:string,notice:string,first:long,words:long,edits:long>>"
)


class Span(NamedTuple):
    label: str
    notice: str
    first: int
    words: int
    edits: int


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def edits_of(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """The notice cut into one piece more than edits, with their offsets: of any match one piece is untouched."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds phrases and notices in texts whose words are parted by single blanks, with a blank at both ends."""

    def __init__(self, phrases: Mapping[str, str], notices: Mapping[str, str]):
        for text in (*phrases, *notices):
            if not text.isascii() or " ".join(w.decode() for w in normal_words(text.encode())) != text:
                raise ValueError(f"not in normal form: {text!r}")
        self.phrases = [(f" {phrase} ".encode(), label) for phrase, label in phrases.items()]
        self.notices = []
        for notice, label in notices.items():
            edits = edits_of(notice)
            found = regex.compile(rf"(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}(?![^ ])", regex.BESTMATCH)
            self.notices.append((notice, label, edits, found, pieces(notice, edits)))

    def places(self, padded: bytes) -> list[tuple[str, int]]:
        """Label and first word of every place where a phrase stands, in the order of the words."""
        out = []
        for phrase, label in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                out.append((label, padded.count(b" ", 0, at)))
                at = padded.find(phrase, at + 1)
        return sorted(out, key=lambda p: (p[1], p[0]))

    def spans(self, padded: bytes) -> list[Span]:
        """The places of notices with their edits, in the order of the words."""
        out: set[Span] = set()
        for notice, label, edits, found, parts in self.notices:
            for start, end in _windows(padded, parts, len(notice), edits):
                window = padded[start:end].decode("utf-8", "replace")
                before = padded.count(b" ", 0, start) - 1
                at = 0
                while (match := found.search(window, at)) is not None and match.end() > match.start():
                    inside = match[0].strip(" ")
                    first = before + window.count(" ", 0, match.start() + len(match[0]) - len(match[0].lstrip(" ")))
                    out.add(Span(label, notice, first, inside.count(" ") + 1, sum(match.fuzzy_counts)))
                    at = match.end()
        return sorted(out, key=lambda s: (s.first, s.words, s.notice))


def _windows(padded: bytes, parts: Sequence[tuple[int, bytes]], length: int, edits: int) -> list[tuple[int, int]]:
    """The stretches, cut at blanks, in which a match must lie whole; overlapping ones are joined."""
    room = _WIDEST * edits
    hits = []
    for offset, piece in parts:
        at = padded.find(piece)
        while at >= 0:
            hits.append(at - offset)
            at = padded.find(piece, at + 1)
    out: list[tuple[int, int]] = []
    for place in sorted(hits):
        start = padded.rfind(b" ", 0, max(place - room, 0) + 1) + 1
        end = padded.find(b" ", place + length + 2 * room)
        end = len(padded) if end < 0 else end
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """``doc_id, n_words, places, spans`` of every row.

    ``places`` holds label and first word of every exact phrase; ``spans`` label, notice, first word, number
    of words and edits of every notice found with at most one edit (a character put in, left out or exchanged) for
    ``CHARS_PER_EDIT`` characters, from word to word. A notice that allows k edits is cut into k + 1 pieces; a match leaves one
    of them untouched, so exact finds of the pieces give the only windows where the bounded-error matcher has to
    look. In a window the best match from left to right is taken; matches of one notice do not overlap.

    No row is shuffled and each text is read whole. A null text counts as empty; repeated ids and null ids are rows of
    their own; an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for rows in batches:
            n, places, spans = [], [], []
            for text in rows.column("norm").cast(pa.binary()).to_pylist():
                words = normal_words(text)
                padded = b" %b " % b" ".join(words)
                n.append(len(words))
                places.append([{"label": label, "word": word} for label, word in scanner.places(padded)])
                spans.append([s._asdict() for s in scanner.spans(padded)])
            arrays = [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, pa.list_(PLACE)), pa.array(spans, pa.list_(SPAN))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "places", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("norm")).mapInArrow(run, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """One line for each row of ``scan``: counts, the outer phrases, sorted labels and a score.

    The score is 1 where a phrase stands, else the largest share of a notice's characters that needs no edit, else 0.
    """
    word = F.transform("places", lambda p: p["word"])
    base, more = F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    alike = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["notice"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(alike, F.lit(0.0))).alias("score"),
        "spans",
    )
