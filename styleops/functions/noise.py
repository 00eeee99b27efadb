"""Noise on ``array<int>`` token columns, driven by keyed draws.

Every function takes the ids column, the row key, its parameter and a seed, and returns a new ids
column. Special symbols keep their place or value as stated.
"""

from __future__ import annotations

import math
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from styleops.functions.draws import hash_uniform
from styleops.functions.text import let

PAD, SOS, EOS, UNK, GMASK = range(5)
TAG_WIDTH = 3


def _sorted_by(ids: Column, shift) -> Column:
    """Reorder by position plus ``shift(id, i)``."""
    keyed = F.transform(
        ids, lambda x, i: F.struct((i + shift(x, i)).alias("key"), i.alias("pos"), x.alias("id"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["id"])


def _pinned(x: Column, free: Column, k: int) -> Column:
    """<sos> stays; <pad> and <eos> move behind everything they could be mixed with."""
    return F.when(x == SOS, F.lit(0.0)).when(x.isin(PAD, EOS), F.lit(float(k + 1))).otherwise(free)


def word_shuffle(ids: Column, key: Column, k: int, seed: int = 0) -> Column:
    def shift(x, i):
        return _pinned(x, (k + 1) * hash_uniform(key, i, "shuffle", seed), k)

    return _sorted_by(ids, shift)


def word_drop(ids: Column, key: Column, p: float, seed: int = 0) -> Column:
    """Drop each id with probability p, but never the first; fill up with <pad>."""
    return let(
        ids,
        lambda a: let(
            F.filter(a, lambda x, i: (i == 0) | (hash_uniform(key, i, "drop", seed) > p)),
            lambda kept: F.concat(kept, F.array_repeat(F.lit(PAD), F.size(a) - F.size(kept))),
        ),
    )


def word_blank(ids: Column, key: Column, p: float, seed: int = 0) -> Column:
    return F.transform(
        ids,
        lambda x, i: F.when(
            ~x.isin(PAD, SOS, EOS) & (hash_uniform(key, i, "blank", seed) < p), F.lit(UNK)
        ).otherwise(x),
    )


def word_substitute(ids: Column, key: Column, p: float, vocab_size: int, seed: int = 0) -> Column:
    def new(i):
        return F.floor(hash_uniform(key, i, "new", seed) * vocab_size).cast("int")

    return F.transform(
        ids,
        lambda x, i: F.when(
            x.isin(SOS, PAD, EOS, GMASK) | (hash_uniform(key, i, "substitute", seed) > p), x
        ).otherwise(new(i)),
    )


def _insert_after(ids: Column, hit, what) -> Column:
    """Insert ``what(i)`` after each hit but at the last place, then append one <pad>."""
    return let(
        ids,
        lambda a: F.concat(
            F.flatten(
                F.transform(
                    a,
                    lambda x, i: F.when(
                        (i < F.size(a) - 1) & hit(x, i), F.array(x, what(i))
                    ).otherwise(F.array(x)),
                )
            ),
            F.array(F.lit(PAD)),
        ),
    )


def insert_tags(ids: Column, key: Column, p: float, tag_ids: Column | None = None, seed: int = 0) -> Column:
    """Insert the positional mask ``[GMASK{i div 3}]``; ``tag_ids`` maps its number to an id."""

    def what(i):
        if tag_ids is None:
            return F.lit(UNK)
        return F.coalesce(F.try_element_at(tag_ids, F.floor(i / TAG_WIDTH).cast("int")), F.lit(UNK))

    return _insert_after(ids, lambda x, i: hash_uniform(key, i, "tag", seed) < p, what)


def duplicate_markers(ids: Column, key: Column, p: float, marker: int = UNK, seed: int = 0) -> Column:
    """Double a marker with probability p. The bare marker name is no symbol, hence <unk>."""
    return _insert_after(
        ids,
        lambda x, i: (x == marker) & (hash_uniform(key, i, "marker", seed) < p),  # only markers are drawn for
        lambda i: F.lit(marker),
    )


def marker_shuffle(ids: Column, key: Column, k: int, marker: int = UNK, seed: int = 0) -> Column:
    """Like ``word_shuffle``, but only ids with a marker within k//2 - 1 places move."""
    reach = k // 2 - 1

    def body(a: Column) -> Column:
        def shift(x, i):
            if reach < 0:
                near = F.lit(False)
            else:
                first = F.greatest(i - reach, F.lit(0))
                near = F.array_contains(F.slice(a, first + 1, i + reach - first + 1), F.lit(marker))
            free = F.when(near, (k + 1) * hash_uniform(key, i, "marker_shuffle", seed)).otherwise(F.lit(0.0))
            return _pinned(x, free, k)

        return _sorted_by(a, shift)

    return let(ids, body)


def _noisy(ids: list[int | None], key: str | None, vocab_size: int, drop: float, blank: float, substitute: float, shuffle: int, tag: float, marker: float, seed) -> list[int | None]:
    """All steps of a row, draw by draw as in the functions above; a null id is no special symbol."""
    head = "" if key is None else f"{key}|"

    def draw(i: int, name: str) -> float:
        return int.from_bytes(md5(f"{head}{i}|{name}|{seed}".encode()).digest()[:4]) / 4294967296.0

    def by_shift(k: int, free) -> list[int | None]:
        ends = float(k + 1)
        order = sorted((i + (0.0 if x == SOS else ends if x == PAD or x == EOS else free(i, x)), i) for i, x in enumerate(ids))
        return [ids[i] for _, i in order]

    def inserted(hit) -> list[int | None]:
        out, last = [], len(ids) - 1
        for i, x in enumerate(ids):
            out.append(x)
            if i < last and hit(i, x):
                out.append(UNK)
        return [*out, PAD]

    if drop > 0:
        kept = [x for i, x in enumerate(ids) if i == 0 or draw(i, "drop") > drop]
        ids = kept + [PAD] * (len(ids) - len(kept))
    if blank > 0:
        ids = [UNK if x is not None and x not in (PAD, SOS, EOS) and draw(i, "blank") < blank else x for i, x in enumerate(ids)]
    if substitute > 0:
        ids = [
            x if x in (SOS, PAD, EOS, GMASK) or draw(i, "substitute") > substitute else math.floor(draw(i, "new") * vocab_size)
            for i, x in enumerate(ids)
        ]
    if marker > 0:
        ids = inserted(lambda i, x: x == UNK and draw(i, "marker") < tag)
        ids = by_shift(3, lambda i, x: 4 * draw(i, "marker_shuffle") if x == UNK else 0.0)  # no place but its own is near
    if tag > 0:
        ids = inserted(lambda i, x: draw(i, "tag") < tag)
    if shuffle > 0:
        ids = by_shift(shuffle, lambda i, x: (shuffle + 1) * draw(i, "shuffle"))
    return ids


def noise_pipeline(
    ids: Column,
    key: Column,
    vocab_size: int,
    drop: float = 0.0,
    blank: float = 0.0,
    substitute: float = 0.0,
    shuffle: int = 0,
    tag: float = 0.0,
    marker: float = 0.0,
    tag_ids: Column | None = None,
    seed: int = 0,
) -> Column:
    """All steps in their fixed order; a step runs if its parameter is above zero.

    ``marker`` only switches the marker steps on: how often markers double is given by ``tag``. Without ``tag_ids`` a row
    takes all steps in one go; with them, one function after the other.
    """
    if tag_ids is None:

        @F.arrow_udf("array<int>")
        def noisy(rows: pa.Array, keys: pa.Array) -> pa.Array:
            steps = (vocab_size, drop, blank, substitute, shuffle, tag, marker, seed)
            found = [None if ids is None else _noisy(ids, key, *steps) for ids, key in zip(rows.to_pylist(), keys.to_pylist())]
            return pa.array(found, pa.list_(pa.int32()))

        return noisy(ids, key.cast("string") if isinstance(key, Column) else F.lit(str(key)))
    if drop > 0:
        ids = word_drop(ids, key, drop, seed)
    if blank > 0:
        ids = word_blank(ids, key, blank, seed)
    if substitute > 0:
        ids = word_substitute(ids, key, substitute, vocab_size, seed)
    if marker > 0:
        ids = marker_shuffle(duplicate_markers(ids, key, tag, seed=seed), key, 3, seed=seed)
    if tag > 0:
        ids = insert_tags(ids, key, tag, tag_ids, seed)
    if shuffle > 0:
        ids = word_shuffle(ids, key, shuffle, seed)
    return ids
