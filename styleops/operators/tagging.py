"""Replace a style's phrases in each sentence by positional tags."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from styleops.functions import text
from styleops.functions.draws import hash_uniform
from styleops.operators import digests, scale
from styleops.operators.ngrams import explode_windows, window
from styleops.operators.vocab import without_cells
from styleops.session import checkpointed

MAX_N = 4
POS_WEIGHT = 3
MAX_POS = 20
SALTS = 16
#: Phrases that every worker may hold, about a hundred megabytes each: in dictionaries, and as digests with their texts in one array.
HELD_PHRASES = 500_000
PACKED_PHRASES = 2_000_000


def tag_position(i: Column, pos_weight: int = POS_WEIGHT, max_pos: int = MAX_POS) -> Column:
    return F.least(F.floor(i / pos_weight).cast("int"), F.lit(max_pos))


def tag(label: Column | str, i: Column, pos_weight: int = POS_WEIGHT, max_pos: int = MAX_POS) -> Column:
    label = label if isinstance(label, Column) else F.lit(label)
    return F.concat(F.lit("["), label, tag_position(i, pos_weight, max_pos).cast("string"), F.lit("]"))


def phrase_candidates(corpus: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """``style, row_id, i, k, phrase``; windows are cut short at the end of the sentence."""
    toks = text.ws_tokens(text.clean_sentence(F.col("txt")))
    at = explode_windows(corpus, ["style", "row_id"], toks, max_n)
    sized = [
        F.struct(F.lit(k).alias("k"), F.concat_ws(" ", *window(k)).alias("phrase"))
        for k in range(1, max_n + 1)
    ]
    return at.select("style", "row_id", "i", F.explode(F.array(*sized)).alias("c")).select(
        "style", "row_id", "i", "c.k", "c.phrase"
    )


def drawn_phrases(row_id: str | None, toks: list[str], scores: dict[str, float], words: list[int], seed, max_n: int) -> Iterator[tuple[int, int]]:
    """The positions with a drawn phrase and the widest window of it, as ``phrase_candidates`` and ``hash_uniform`` have them.

    ``words`` are the numbers of words of the phrases, the largest first. At the end of a sentence wider windows are cut
    short and hold the same phrase.
    """
    parts = [] if row_id is None else [row_id]
    for i in range(len(toks)):
        for n in words:
            left = len(toks) - i
            score = scores.get(toks[i] if n == 1 else " ".join(toks[i : i + n])) if n <= left else None
            if score is None:
                continue
            windows = range(max_n, n - 1, -1) if n == left else (n,)
            u = (int(md5("|".join([*parts, str(i), str(k), str(seed)]).encode()).hexdigest()[:8], 16) / 4294967296.0 for k in windows)
            k = next((k for k, x in zip(windows, u) if x < score), None)
            if k is not None:
                yield i, k
                break


def held_hits(corpus: DataFrame, phrases: DataFrame, seed: int, max_n: int) -> DataFrame:
    """``style, row_id, i, k`` of the drawn phrases of each row; every worker holds the phrases."""
    # as in Spark, any number is below NaN
    best = phrases.filter("style IS NOT NULL AND phrase IS NOT NULL AND score IS NOT NULL").groupBy("style", "phrase").agg(F.max("score").alias("score"))
    table: dict[str, dict[str, float]] = {}
    for style, phrase, score in best.toPandas().itertuples(index=False):
        if phrase.count(" ") < max_n:
            table.setdefault(style, {})[phrase] = float("inf") if score != score else float(score)
    sizes = {style: sorted({p.count(" ") + 1 for p in scores}, reverse=True) for style, scores in table.items()}
    held = corpus.sparkSession.sparkContext.broadcast((table, sizes))

    @F.pandas_udf(ArrayType(LongType()))
    def found(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table, sizes = held.value
        for ids, styles, texts in batches:
            yield pd.Series(
                [
                    [i << 32 | k for i, k in drawn_phrases(row_id, toks.split(), table[style], sizes[style], seed, max_n)]
                    if style in table and toks is not None
                    else []
                    for row_id, style, toks in zip(ids, styles, texts)
                ],
                dtype=object,
            )

    toks = F.array_join(text.ws_tokens(text.clean_sentence(F.col("txt"))), " ")
    at = found(F.col("row_id").cast("string"), F.col("style"), toks)
    hits = corpus.select("style", "row_id", F.explode(at).alias("at"))
    return hits.select("style", "row_id", F.shiftright("at", 32).cast("int").alias("i"), F.col("at").bitwiseAND(255).cast("int").alias("k"))


def phrase_hits(
    corpus: DataFrame, lexicon: DataFrame, seed: int = 0, max_n: int = MAX_N, broadcast_rows: int = scale.BROADCAST_ROWS
) -> DataFrame:
    """``style, row_id, i, k``: widest phrase at each position that is in the lexicon and drawn.

    Of a lexicon of at most ``HELD_PHRASES`` phrases (or ``broadcast_rows``, if fewer) every worker holds the phrases and looks them up
    in its rows, so only hits are shuffled. A lexicon of at most ``broadcast_rows`` phrases is broadcast. For a larger one, a filter of its phrases drops nearly all candidates
    that are no phrase where they are made, so about the hits are shuffled. A mined lexicon tells how often its phrases
    occur, so its frequent phrases are broadcast whatever its size; one without frequencies is copied ``SALTS``
    times and the candidates of one phrase are dealt over the copies.
    """
    phrases = lexicon.withColumnsRenamed({"main_style": "style", "term": "phrase"})
    if scale.bounded(phrases, min(HELD_PHRASES, broadcast_rows)):
        return _widest(held_hits(corpus, phrases, seed, max_n))
    found = phrase_candidates(corpus, max_n)
    keys = ["style", "phrase"]
    small = scale.bounded(phrases, broadcast_rows)
    if not small:
        found = found.filter(scale.key_filter(phrases, keys)(F.col("style"), F.col("phrase")))
    if "freq" in lexicon.columns:
        joined = scale.lookup_join(found, phrases.select(*keys, "score", "freq"), keys, "freq", broadcast_rows=broadcast_rows)
    elif small:
        joined = found.join(F.broadcast(phrases.select(*keys, "score")), keys)
    else:
        salt = F.pmod(F.xxhash64("row_id", "i"), F.lit(SALTS)).cast("int")
        copies = phrases.select(*keys, "score", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = found.withColumn("salt", salt).join(copies, [*keys, "salt"])
    drawn = hash_uniform(F.col("row_id"), F.col("i"), F.col("k"), seed) < F.col("score")
    return _widest(joined.filter(drawn).select("style", "row_id", "i", "k"))


def _widest(hits: DataFrame) -> DataFrame:
    return hits.repartition("row_id").groupBy("style", "row_id", "i").agg(F.max("k").alias("k"))


def tagged_text(
    toks: Column,
    hits: Column,
    label: Column | str,
    concat: bool = True,
    pos_weight: int = POS_WEIGHT,
    max_pos: int = MAX_POS,
) -> Column:
    """Walk the hits of a row (``array<struct<i, k>>``, ascending) and build the tagged text.

    The first fold picks hits left to right that do not start inside an earlier one; the text is
    then put together from the pieces between the picked hits.
    """
    nothing = F.array().cast("array<struct<i:int,k:int>>")
    start = F.struct(F.lit(0).alias("nxt"), nothing.alias("picked"))
    picked = F.aggregate(
        hits,
        start,
        lambda s, h: F.when(h["i"] < s["nxt"], s).otherwise(
            F.struct(
                (h["i"] + h["k"]).alias("nxt"),
                F.concat(s["picked"], F.array(F.struct(h["i"].alias("i"), h["k"].alias("k")))).alias("picked"),
            )
        ),
        lambda s: s["picked"],
    )

    def assemble(ps: Column) -> Column:
        def end_before(j: Column) -> Column:
            return F.coalesce(F.get(ps, j - 1)["i"] + F.get(ps, j - 1)["k"], F.lit(0))

        def piece(p: Column, j: Column) -> Column:
            gap = F.slice(toks, end_before(j) + 1, p["i"] - end_before(j))
            mark = F.array(tag(label, p["i"], pos_weight, max_pos))
            if not concat:
                return F.concat(gap, mark)
            return F.when((j > 0) & (p["i"] == end_before(j)), gap).otherwise(F.concat(gap, mark))

        tail = F.slice(toks, end_before(F.size(ps)) + 1, F.size(toks))
        return F.array_join(F.concat(F.flatten(F.transform(ps, piece)), tail), " ")

    return F.when(F.size(toks) == 0, F.lit("")).otherwise(text.let(picked, assemble))


def joined_text(toks: list[str], hits: list[tuple[int, int]], label: str | None, concat: bool, pos_weight: int, max_pos: int) -> str:
    """The text that ``tagged_text`` builds."""
    out, end, first = [], 0, True
    for i, k in hits:
        if i < end:
            continue
        out += toks[end:i]
        if label is not None and (first or i != end or not concat):
            out.append(f"[{label}{min(math.floor(i / pos_weight), max_pos)}]")
        end, first = i + k, False
    return " ".join(out + toks[end:])


class PackedPhrases:
    """The phrases of one style by digests of 64 bits, with their texts, so that a found digest is always compared."""

    def __init__(self, phrases: list[str], scores: list[float]):
        many = np.asarray([p.count(" ") + 1 for p in phrases], np.int64)
        code = np.zeros(len(phrases), np.uint64)
        self.sizes = sorted(set(many.tolist()), reverse=True)
        for n in self.sizes:
            at = np.flatnonzero(many == n)
            words = digests.hashed([w for k in at.tolist() for w in phrases[k].split(" ")]).reshape(-1, n)
            own = words[:, 0]
            for d in range(1, n):
                own = digests.mixed(own, words[:, d])
            code[at] = own
        order = np.argsort(code)
        self.digests, self.scores = code[order], np.asarray(scores, float)[order]
        self.texts = pa.array(phrases, pa.string()).take(pa.array(order))

    @classmethod
    def of_parts(cls, parts: dict) -> PackedPhrases:
        """From the attributes of another one, which travel as plain arrays."""
        new = cls.__new__(cls)
        new.__dict__.update(parts)
        return new

    def distinct(self) -> bool:
        return bool((self.digests[1:] != self.digests[:-1]).all())

    def found(self, rows: list[list[str]]) -> list[list[tuple[int, int, float]]]:
        """The place, the number of words and the score of each phrase in each row, of a place the longest first."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in rows]
        words = [w for row in rows for w in row]
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        start = np.cumsum([0, *map(len, rows)])
        tokens = digests.hashed(words)
        code, hits = tokens, []
        for n in range(1, max(self.sizes, default=0) + 1):
            if n > 1:
                code = digests.mixed(code[: max(len(tokens) - n + 1, 0)], tokens[n - 1 :])
            if n not in self.sizes:
                continue
            at = np.searchsorted(self.digests, code).clip(max=len(self.digests) - 1)
            place = np.flatnonzero((self.digests[at] == code) & (row[: len(code)] == row[n - 1 :]))
            at = at[place]
            for p, text_, score in zip(place.tolist(), self.texts.take(pa.array(at)).to_pylist(), self.scores[at].tolist()):
                if text_ == " ".join(words[p : p + n]):
                    hits.append((p, -n, score))
        for p, n, score in sorted(hits):
            out[row[p]].append((int(p - start[row[p]]), -n, score))
        return out


def packed_phrases(phrases: DataFrame, max_n: int) -> dict[str, PackedPhrases] | None:
    """The phrases of each style, the best score of each; None if two digests meet."""
    # as in Spark, any number is below NaN
    best = phrases.filter("style IS NOT NULL AND phrase IS NOT NULL AND score IS NOT NULL").groupBy("style", "phrase").agg(F.max("score").alias("score"))
    out = {}
    for style, part in best.toPandas().groupby("style"):
        part = part[part["phrase"].str.count(" ") < max_n]
        out[style] = PackedPhrases(part["phrase"].tolist(), part["score"].astype(float).fillna(float("inf")).tolist())
    return out if all(p.distinct() for p in out.values()) else None


def drawn_hits(key: str, length: int, found: list[tuple[int, int, float]], seed, max_n: int) -> Iterator[tuple[int, int]]:
    """``drawn_phrases`` of the phrases found in a row of ``length`` words."""
    done = -1
    for i, n, score in found:
        if i != done:
            for k in range(max_n, n - 1, -1) if n == length - i else (n,):
                if int.from_bytes(md5(f"{key}|{i}|{k}|{seed}".encode()).digest()[:4]) / 4294967296.0 < score:
                    yield i, k
                    done = i
                    break


def _tagged(held: Broadcast, seed: int, concat: bool, max_n: int, pos_weight: int, max_pos: int):
    """``orig`` of rows in the order of their keys gets ``tagged``; rows of one key share their hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tagged(key: str | None, rows: list[tuple[str | None, list[str], list]]) -> list[str]:
            hits: list[tuple[int, int]] = []
            if key is not None:  # rows without a key meet no hits
                widest: dict[tuple, int] = {}
                for style, toks, found in rows:
                    for i, k in drawn_hits(key, len(toks), found, seed, max_n):
                        widest[style, i] = max(k, widest.get((style, i), 0))
                hits = sorted((i, k) for (_, i), k in widest.items())
            return [joined_text(toks, hits, style, concat, pos_weight, max_pos) for style, toks, _ in rows]

        kept: list[pa.RecordBatch] = []
        names = ["row_id", "style", "split", "orig", "tagged"]

        def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            out: list[str] = []
            styles, toks = rows.column("style").to_pylist(), [t.split() for t in rows.column("orig").to_pylist()]
            found: list[list] = [[] for _ in toks]
            for style, parts in held.value.items():
                phrases = PackedPhrases.of_parts(parts)
                at = [k for k, s in enumerate(styles) if s == style]
                for k, of in zip(at, phrases.found([toks[k] for k in at])):
                    found[k] = of
            for key, same in groupby(zip(rows.column("_key").to_pylist(), styles, toks, found), lambda c: c[0]):
                out += tagged(key, [c[1:] for c in same])
            yield from rows.append_column("tagged", pa.array(out, pa.string())).select(names).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            # the rows of the last key may go on in the next batch
            keys = batch.column("_key")
            last, at = keys[-1].as_py(), batch.num_rows
            while at and keys[at - 1].as_py() == last:
                at -= 1
            if at:
                yield from made(pa.Table.from_batches([*kept, batch.slice(0, at)]))
                kept = []
            kept.append(batch.slice(at))
            if kept[0].column("_key")[0].as_py() != last:
                yield from made(pa.Table.from_batches(kept[:-1]))
                kept = kept[-1:]
        if kept:
            yield from made(pa.Table.from_batches(kept))

    return run


def tag_by_join(
    corpus: DataFrame,
    lexicon: DataFrame,
    seed: int = 0,
    concat: bool = True,
    max_n: int = MAX_N,
    pos_weight: int = POS_WEIGHT,
    max_pos: int = MAX_POS,
) -> DataFrame:
    """Tag through a lookup, whatever the size of the lexicon.

    Of one with at most ``PACKED_PHRASES`` phrases every worker holds all, so the texts are shuffled once, by row, and hits never.
    """
    rows = corpus.filter(F.col("txt").isNotNull())
    orig = text.clean_sentence(F.col("txt"))
    phrases = lexicon.withColumnsRenamed({"main_style": "style", "term": "phrase"})
    packed = packed_phrases(phrases, max_n) if scale.bounded(phrases, PACKED_PHRASES) else None
    if packed is not None:
        held = corpus.sparkSession.sparkContext.broadcast({style: vars(p) for style, p in packed.items()})
        kept = rows.select("row_id", "style", "split", orig.alias("orig"), F.col("row_id").cast("string").alias("_key"))
        laid = scale.spread(kept, "_key").sortWithinPartitions("_key")
        types = {f.name: f.dataType.simpleString() for f in kept.schema}
        schema = ", ".join([f"{c} {types[c]}" for c in ("row_id", "style", "split", "orig")])
        return laid.mapInArrow(_tagged(held, seed, concat, max_n, pos_weight, max_pos), f"{schema}, tagged string")
    # candidates meet the lexicon where the text is read; only the drawn hits and, unless the
    # hits turn out small enough to broadcast, the text are shuffled, once each
    hits = (
        phrase_hits(rows, lexicon, seed, max_n)
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_list(F.struct("i", "k"))).alias("hits"))
    )
    none = F.array().cast("array<struct<i:int,k:int>>")
    joined = rows.join(hits, ["row_id"], "left")
    return joined.select(
        "row_id",
        "style",
        "split",
        orig.alias("orig"),
        text.let(
            text.ws_tokens(orig),
            lambda toks: tagged_text(
                toks, F.coalesce(F.col("hits"), none), F.col("style"), concat, pos_weight, max_pos
            ),
        ).alias("tagged"),
    )


def tag_sentences(corpus: DataFrame, lexicon: DataFrame, seed: int = 0, **options) -> DataFrame:
    """``row_id, style, split, orig, tagged``; each row is tagged with its own style's phrases."""
    return tag_by_join(corpus, checkpointed(lexicon), seed, **options)


def tag_stats(tagged: DataFrame) -> DataFrame:
    """Per (split, style): sentences, kept sentences, tags and tags per sentence."""
    marks = F.regexp_count(F.col("tagged"), F.concat(F.lit(r"\[\Q"), F.col("style"), F.lit(r"\E[0-9]+\]")))
    kept = F.contains(F.col("tagged"), F.col("style")).cast("long")
    return (
        tagged.select("split", "style", marks.alias("marks"), kept.alias("kept"))
        .groupBy("split", "style")
        .agg(
            F.count(F.lit(1)).alias("sentences"),
            F.sum("kept").alias("kept"),
            F.sum("marks").alias("tags"),
            F.avg("marks").alias("tags_per_sentence"),
        )
    )


def mask_tokens(
    encoded: DataFrame, ids: str, scores: DataFrame, seed: int = 0, mask_id: int = 4, by: Sequence[str] = ()
) -> DataFrame:
    """Replace an id by the mask id with the probability its phrase has (``scores``: *by, id, score, cnt).

    ``by`` names columns of both tables, such as the style, that have to agree. A row without ids keeps none.
    """
    keys = [*by, "id"]
    cells = encoded.select("pair_id", *by, F.posexplode(ids).alias("pos", "id"))
    scored = scale.lookup_join(cells, scores, keys, weight="cnt", how="left")
    drawn = hash_uniform(F.col("pair_id"), F.col("pos"), seed) < F.col("score")
    new = F.when(drawn, F.lit(mask_id)).otherwise(F.col("id"))
    masked = (
        scored.groupBy("pair_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", new.alias("id")))).alias("cells"))
        .select("pair_id", F.col("cells.id").alias(ids))
    )
    return masked.unionByName(without_cells(encoded, "pair_id", F.col(ids), ids, F.array().cast("array<int>")))
