"""Encoding by the tokenizers library with each distinct chunk of text encoded once per worker.

A chunk is a run of text that the tokenizer's splitter treats alike wherever it stands: a word with
the one blank or line break before it. Texts with other white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

#: Chunks remembered by one worker; longer ones are not remembered, so its memory is bounded.
MEMO_CHUNKS = 1_000_000
MEMO_CHARS = 48
#: Chunks joined into one call of the library.
JOINED = 256
ODD_SPACE = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def encode_joined(path: str, chunks: Sequence[str]) -> list[bytes]:
    """The ids of each chunk, as little-endian 32-bit numbers; chunks start with white space, so they may stand side by side."""
    parts = [chunks[k : k + JOINED] for k in range(0, len(chunks), JOINED)]
    out = []
    for part, done in zip(parts, tokenizer(path).encode_batch(["".join(p) for p in parts], add_special_tokens=False), strict=True):
        ends = np.cumsum([len(c) for c in part])
        data = np.asarray(done.ids, dtype="<u4").tobytes()
        cuts = 4 * np.searchsorted(np.asarray([e for _, e in done.offsets], dtype=np.int64), ends, side="right")
        at = 0
        for cut in cuts.tolist():
            out.append(data[at:cut])
            at = cut
    return out


class Memo:
    """Values of chunks, made for all the unknown chunks of a batch at once; long ones are forgotten after it."""

    def __init__(self, make: Callable[[list], list], limit: int = MEMO_CHUNKS):
        self.make, self.limit, self.kept, self.long = make, limit, {}, []

    def of(self, batch: list[list]) -> dict:
        for chunk in self.long:
            del self.kept[chunk]
        now = set().union(*batch)
        if len(self.kept) > self.limit:  # the frequent ones are in this batch too
            self.kept = {c: self.kept[c] for c in now.intersection(self.kept)}
        new = list(now.difference(self.kept))
        self.kept.update(zip(new, self.make(new), strict=True))
        self.long = [c for c in new if len(c) > MEMO_CHARS]
        return self.kept


@lru_cache(maxsize=4)
def count_memo(path: str) -> Memo:
    def make(words: list[bytes]) -> list[int]:
        return [len(x) // 4 for x in encode_joined(path, [" " + w.decode("utf-8", "replace") for w in words])]

    return Memo(make)


@lru_cache(maxsize=4)
def ids_memo(path: str) -> Memo:
    def make(keys: list[str]) -> list[bytes]:
        return encode_joined(path, [k if k[0] == "\n" else " " + k for k in keys])

    return Memo(make)


def count_words(path: str, texts: Sequence[str]) -> list[int]:
    """Token counts by a tokenizer that drops white space and never joins words over it."""
    batch = [t.encode("utf-8", "replace").split() for t in texts]
    known = count_memo(path).of(batch)
    return [sum(map(known.__getitem__, words)) for words in batch]


def regular(text: str) -> bool:
    """True if words stand apart by one blank or one line break, with none at either end."""
    return not (
        not text
        or text[0] in " \n"
        or text[-1] in " \n"
        or "  " in text
        or "\n\n" in text
        or " \n" in text
        or "\n " in text
        or ODD_SPACE.search(text)
    )


def chunk_keys(text: str) -> list[str]:
    """The chunks of a regular text, the blank before each left out; the first one is marked by a NUL."""
    return ("\0" + text.replace("\n", " \n")).split(" ")


def chunk_of(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


def one_word(chunk: str) -> bool:
    """True for plain letters with at most one blank before them, which no splitter parts."""
    return chunk.isascii() and (chunk.isalpha() or (chunk[:1] == " " and chunk[1:].isalpha()))


def encode_texts(path: str, texts: Sequence[str]) -> list[bytes]:
    """Little-endian 32-bit ids of each text by a byte-level tokenizer, without added special tokens."""
    out: list[bytes] = [b""] * len(texts)
    plain = [k for k, t in enumerate(texts) if regular(t)]
    other = [k for k, t in enumerate(texts) if t and not regular(t)]
    for k in other:
        out[k] = np.asarray(tokenizer(path).encode(texts[k], add_special_tokens=False).ids, dtype="<u4").tobytes()
    words = [texts[k].replace("\n", " \n").split(" ") for k in plain]
    heads = tokenizer(path).encode_batch([w[0] for w in words], add_special_tokens=False) if words else []
    known = ids_memo(path).of([w[1:] for w in words])
    for k, head, w in zip(plain, heads, words, strict=True):
        out[k] = np.asarray(head.ids, dtype="<u4").tobytes() + b"".join(map(known.__getitem__, w[1:]))
    return out
