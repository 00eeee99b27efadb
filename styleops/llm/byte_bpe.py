"""Byte-level BPE by merge replay over the distinct words of a block of documents."""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleops.llm.chunks import MEMO_CHARS, Memo, chunk_keys, chunk_of, one_word, regular
from styleops.llm.common import blocks, small_batches, whole_text

#: Texts are gathered into blocks of about this many characters, each replayed at once.
BLOCK_CHARS = 3_000_000
#: Words, chunks and pairs remembered by one worker.
MEMO_WORDS, MEMO_CHUNKS, MEMO_PAIRS = 500_000, 400_000, 300_000


class Merges:
    """The ranks of a vocabulary; a token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.rank = {base64.b64decode(token): int(number) for token, number in pairs}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, number in self.rank.items():
            self.token[number] = token
        self.byte = np.asarray([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.bytes_rank = np.asarray([[self.rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int64)
        self.joined: dict[tuple[int, int], int] = {}

    def pairs(self) -> dict[tuple[int, int], int]:
        """What two neighbours become, -1 if the vocabulary has no such token: of bytes first, others filled as they are met."""
        if not self.joined or len(self.joined) > MEMO_PAIRS:
            a, b = np.nonzero(self.bytes_rank >= 0)
            codes = zip(self.byte[a].tolist(), self.byte[b].tolist(), strict=True)
            self.joined = dict(zip(codes, self.bytes_rank[a, b].tolist(), strict=True))
        return self.joined


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of each word (little-endian unsigned 32-bit), merged as the ranks say: lowest rank first, leftmost first.

    A word that is a token itself is taken whole. The others lie in one row of symbols with links to their
    neighbours. An index from rank to the positions where such a pair starts is worked off in the
    order of ranks; a merge touches only the pairs on its two sides. If a merge makes a pair of a
    lower rank in a word, the word's remaining positions of the present rank wait until that pair is done.
    """
    out = [merges.rank[w].to_bytes(4, "little") if w in merges.rank else b"" for w in words]
    parts = [k for k, ids in enumerate(out) if not ids and words[k]]
    if not parts:
        return out
    raw = np.frombuffer(b"".join([words[k] for k in parts]), dtype=np.uint8)
    n, ends = len(raw), np.cumsum([len(words[k]) for k in parts])
    starts = np.concatenate([[0], ends[:-1]])
    ranked = np.full(n, -1, dtype=np.int64)
    ranked[:-1] = merges.bytes_rank[raw[:-1], raw[1:]]
    ranked[ends - 1] = -1
    found = np.flatnonzero(ranked >= 0)
    found = found[np.argsort(ranked[found], kind="stable")]
    heads = np.flatnonzero(np.diff(ranked[found], prepend=-1))
    cuts = [*heads.tolist(), len(found)]
    index = {r: found[a:b].tolist() for r, a, b in zip(ranked[found[heads]].tolist(), cuts, cuts[1:], strict=False)}
    symbols = merges.byte[raw].tolist()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1], before[starts] = -1, -1
    starts = starts.tolist()
    after, before = after.tolist(), before.tolist()
    joined, token, rank_of, heappush = merges.pairs(), merges.token, merges.rank.get, heapq.heappush
    ranks = list(index)
    heapq.heapify(ranks)
    while ranks:
        rank = heapq.heappop(ranks)
        positions = index.pop(rank)
        positions.sort()
        held: set[int] = set()
        late: list[int] = []
        for at in positions:
            right = after[at]
            if right < 0 or joined.get((symbols[at], symbols[right])) != rank:
                continue  # a merge on either side was first
            if held and bisect_right(starts, at) in held:
                late.append(at)
                continue
            symbols[at], symbols[right] = rank, -1
            after[at] = far = after[right]
            if far >= 0:
                before[far] = at
                pair = (rank, symbols[far])
                new = joined.get(pair)
                if new is None:
                    new = joined[pair] = rank_of(token[rank] + token[pair[1]], -1)
                if new >= 0:
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heappush(ranks, new)
                    if new < rank:
                        held.add(bisect_right(starts, at))
            left = before[at]
            if left >= 0:
                pair = (symbols[left], rank)
                new = joined.get(pair)
                if new is None:
                    new = joined[pair] = rank_of(token[pair[0]] + token[rank], -1)
                if new >= 0:
                    if new in index:
                        index[new].append(left)
                    else:
                        index[new] = [left]
                        heappush(ranks, new)
                    if new < rank:
                        held.add(bisect_right(starts, at))
        if late:
            if rank in index:
                index[rank].extend(late)
            else:
                index[rank] = late
                heappush(ranks, rank)
    left = np.asarray(symbols)
    live = left >= 0
    counts = (4 * np.concatenate([[0], np.cumsum(live)])[np.concatenate([[0], ends])]).tolist()
    left = left[live].astype("<u4").tobytes()
    for k, a, b in zip(parts, counts, counts[1:], strict=False):
        out[k] = left[a:b]
    return out


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


class Codec:
    """Encodes blocks of texts; words and chunks already replayed by this worker are looked up."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.split = merges_of(path), _splitter(pattern).findall
        self.words: dict[str, bytes] = {}
        self.chunks = Memo(lambda keys: self._encoded([chunk_of(k) for k in keys]), MEMO_CHUNKS)

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        parts = [[c] if one_word(c) else self.split(c) for c in chunks]
        if len(self.words) > MEMO_WORDS:
            self.words = {w: self.words[w] for p in parts for w in p if w in self.words}
        words = self.words
        fresh = list({w for p in parts for w in p if w not in words})
        words.update(zip(fresh, replay([w.encode("utf-8", "replace") for w in fresh], self.merges), strict=True))
        out = [words[p[0]] if len(p) == 1 else b"".join(map(words.__getitem__, p)) for p in parts]
        for word in fresh:
            if len(word) > MEMO_CHARS:
                del words[word]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [k for k, t in enumerate(texts) if regular(t)]
        other = [k for k, t in enumerate(texts) if t and not regular(t)]
        out = [b""] * len(texts)
        for k, ids in zip(other, self._encoded([texts[k] for k in other]), strict=True):
            out[k] = ids
        cut = [chunk_keys(texts[k]) for k in plain]
        known = self.chunks.of(cut)
        for k, keys in zip(plain, cut, strict=True):
            out[k] = b"".join(map(known.__getitem__, keys))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``doc_id, ids``: little-endian unsigned 32-bit ids of each whole text; a null text has none.

    With ``decoded``, also the bytes that the ids stand for, made by the same worker: a UDF behind this
    one would give each running task a second Python process. Every row gives a row; ids may be null or
    repeat; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path, pattern)
        for rows in blocks(batches, "norm", BLOCK_CHARS):
            ids = coder.encode(rows["norm"].tolist())
            made = {"doc_id": rows["doc_id"].astype("Int64"), "ids": ids}
            yield pd.DataFrame(made | {"decoded": list(map(coder.decode, ids))} if decoded else made)

    fields = "doc_id long, ids binary" + ", decoded binary" * decoded
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("norm")).mapInPandas(run, fields)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes its ``ids`` stand for (replaced if there is one)."""

    @F.pandas_udf("binary")
    def back(ids: pd.Series) -> pd.Series:
        return ids.map(codec(path, pattern).decode, na_action="ignore")

    return encoded.withColumn("decoded", back("ids"))
