"""Vocabulary, id encoding and vectors by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styleops.functions import text
from styleops.operators import scale
from styleops.operators.ngrams import explode_windows
from styleops.session import checkpointed

# The special symbols and their ids.
SPECIALS = ["<pad>", "<sos>", "<eos>", "<unk>", "[GMASK]"]
PAD, SOS, EOS, UNK, GMASK = range(5)
#: Tokens that every worker may hold, about a hundred megabytes, and tokens that a worker sums up before it hands them on.
HELD_TOKENS = 500_000
SUMMED_TOKENS = 500_000
#: Blocks of rows, whose rarer tokens are looked up together, for each shuffle partition.
BLOCKS = 4


def word_freq(lines: DataFrame) -> DataFrame:
    """``word, freq`` over all lines."""
    return (
        explode_windows(lines, [], text.ws_tokens(F.col("txt")), 1)
        .groupBy(F.col("w0").alias("word"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def _first_seen(order: Sequence[str]):
    """``token, cnt, *order, i``: how often a token occurs in some rows and its first place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers and the keys of rows only, as a container for each token would keep the collector busy
        cnt: dict[str, int] = {}
        first: dict[str, tuple] = {}
        place: dict[str, int] = {}
        for rows in batches:
            types = [rows.schema.field(c).type for c in order]

            def made() -> pa.RecordBatch:
                values = [pa.array([key[k][1] for key in first.values()], t) for k, t in enumerate(types)]
                counts, i = pa.array(list(cnt.values()), pa.int64()), pa.array(list(place.values()), pa.int32())
                return pa.RecordBatch.from_arrays([pa.array(list(cnt), pa.string()), counts, *values, i], ["token", "cnt", *order, "i"])

            # as in Spark, null comes before any value
            keys = zip(*[[(x is not None, x) for x in rows.column(c).to_pylist()] for c in order]) if order else [()] * rows.num_rows
            for key, toks in zip(keys, rows.column("toks").to_pylist()):
                for i, token in enumerate((toks or "").split()):
                    times = cnt.get(token, 0)
                    cnt[token] = times + 1
                    if not times or key < first[token] or (key == first[token] and i < place[token]):
                        first[token], place[token] = key, i
                if len(cnt) > SUMMED_TOKENS:
                    yield made()
                    cnt, first, place = {}, {}, {}
        if cnt:
            yield made()

    return run


def build_vocab(
    lines: DataFrame, order: Sequence[str], min_freq: int = 2, max_size: int | None = None
) -> DataFrame:
    """``id, token, cnt``: frequent tokens first, of equally frequent ones the latest new one first.

    ``order`` names the columns that give the reading order of the lines.
    """
    spark = lines.sparkSession
    seen = F.min(F.struct(*order, "i")).alias("seen")
    types = {c: lines.schema[c].dataType.simpleString() for c in order}
    # the first place is a struct, by which Spark aggregates only after a sort, so tokens are summed up where they are read
    rows = lines.select(*order, F.col("txt").alias("toks"))  # Python splits at the same white space
    schema = ", ".join(["token string", "cnt long", *[f"`{c}` {t}" for c, t in types.items()], "i int"])
    counts = (
        rows.mapInArrow(_first_seen(list(order)), schema)
        .groupBy("token")
        .agg(F.sum("cnt").alias("cnt"), seen)
        .filter(F.col("cnt") >= min_freq)
    )
    placed = scale.ordered_index(counts, [F.desc("cnt"), F.desc("seen")], "at")
    if max_size is not None:
        placed = placed.filter(F.col("at") < max_size)
    # a data token that equals a special symbol takes no id of its own: at most five rows
    clashes = [r["at"] for r in placed.filter(F.col("token").isin(SPECIALS)).select("at").collect()]
    skipped: Column = F.lit(0)
    for at in clashes:
        skipped = skipped + (F.col("at") > at).cast("int")
    words = placed.filter(~F.col("token").isin(SPECIALS)).select(
        (F.col("at") - skipped + len(SPECIALS)).cast("int").alias("id"), "token", "cnt"
    )
    head = spark.createDataFrame(
        [(i, s, 0) for i, s in enumerate(SPECIALS)], "id int, token string, cnt long"
    )
    return head.unionByName(words)


def weighted(vocab: DataFrame) -> DataFrame:
    """The vocabulary, written once, with the special symbols counted as very frequent."""
    written = checkpointed(vocab)
    total = written.agg(F.sum("cnt")).first()[0] or 1
    return written.withColumn("cnt", F.when(F.col("id") < len(SPECIALS), F.lit(total)).otherwise(F.col("cnt")))


def without_cells(rows: DataFrame, key: str, cells: Column, name: str, empty: Column) -> DataFrame:
    """The rows with no token or id; kept apart, since they would meet as one null key in a lookup."""
    return rows.filter(F.coalesce(F.size(cells), F.lit(0)) <= 0).select(key, empty.alias(name))


def held_table(vocab: DataFrame, key: str, value: str) -> dict | None:
    """``value`` by ``key``, if there are at most ``HELD_TOKENS`` rows and no key comes twice."""
    if not scale.bounded(vocab, HELD_TOKENS):
        return None
    rows = vocab.select(key, value).collect()
    table = {r[0]: r[1] for r in rows if r[0] is not None}
    return table if len(table) == len(rows) else None


def _copies(rows: DataFrame, key: str) -> DataFrame:
    """``key, _of``: what the rows of a key have, one as a rule."""
    return scale.spread(rows, key).groupBy(key).agg(F.collect_list("_of").alias("_of"))


def _held(rows: DataFrame, table: dict, looked_up: Callable[[object, dict], list], kind: str = "array<int>"):
    """A column function: the cells that ``looked_up`` gives for each of a key's rows, of several by place and value."""
    held = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(kind)
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out = []
            for copies in column:
                found = [looked_up(of, held.value) for of in copies]
                if len(found) > 1:
                    places = sorted((i, x is not None, x) for f in found for i, x in enumerate(f))
                    found = [[x for _, _, x in places]]
                out += found
            yield pd.Series(out, dtype=object)

    return cells


def token_ids(vocab: DataFrame) -> tuple[dict[str, int], DataFrame | None] | None:
    """The ids of the ``HELD_TOKENS`` most common tokens and the table of the others, if there are any; None if a token comes twice."""
    if scale.repeated(vocab, "token"):
        return None
    named = vocab.filter("token IS NOT NULL AND id IS NOT NULL")
    whole = scale.bounded(vocab, HELD_TOKENS)
    head = F.lit(True) if whole else F.coalesce(scale.most_common(vocab, HELD_TOKENS, "cnt"), F.lit(False))
    held = dict(named.filter(head).select("token", "id").toPandas().itertuples(index=False, name=None))
    return held, None if whole else named.filter(~head).select("token", "id")


def _asked(held, names: list[str]):
    """``block, token`` for the tokens of a block of rows that the workers do not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, set[str]] = {}
        many = 0

        def made() -> Iterator[pa.RecordBatch]:
            blocks = np.repeat(np.fromiter(asked, np.int64, len(asked)), [len(x) for x in asked.values()])
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([t for x in asked.values() for t in x], pa.string())], ["block", "token"])

        for rows in batches:
            for block, *texts in zip(*(rows.column(c).to_pylist() for c in ["block", *names])):
                for txt in texts:
                    tokens = {t for t in (txt or "").split() if t not in held.value}
                    if tokens:
                        asked.setdefault(block, set()).update(tokens)
                        many += len(tokens)
            if many > SUMMED_TOKENS:
                yield from made()
                asked, many = {}, 0
        if asked:
            yield from made()

    return run


def _ids_of_key(copies: list[tuple], names: int, found: Callable[[str], list[int]]) -> list[tuple]:
    """The ids of the rows of one key: its texts as one row, those of several sorted by place and id, and each blank text as one."""
    sides = []
    for k in range(names):
        ids = [found(c[k]) if c[k] else [] for c in copies]
        own = [x for x in ids if x]
        if len(own) > 1:
            own = [[x for _, x in sorted((i, x) for row in own for i, x in enumerate(row))]]
        sides.append(own + [[]] * (len(ids) - sum(map(bool, ids))))
    return [*product(*sides)]


def _encoded(held, names: list[str]):
    """The ids of texts by the tokens that the workers hold and, of a block, those that come before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, pending = None, {}, []
        get = held.value.get

        def ids(txt: str) -> list[int]:
            if own:
                return [own.get(t, UNK) if (x := get(t)) is None else x for t in txt.split()]
            return [get(t, UNK) for t in txt.split()]

        def made(keys: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = []
            for side in zip(*rows) if rows else [()] * len(names):
                ends = np.cumsum([0, *map(len, side)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array([x for ids in side for x in ids], pa.int32())))
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *columns], ["key", *(f"ids{k}" for k in range(len(names)))])

        last, kind = None, pa.null()
        for rows in batches:
            keys, out = [], []
            kind = rows.schema.field("key").type

            def done() -> None:
                for row in _ids_of_key(pending, len(names), ids) if pending else ():
                    keys.append(last)
                    out.append(row)

            for block, token, number, key, *texts in zip(*(rows.column(c).to_pylist() for c in ["block", "token", "id", "key", *names])):
                if block != at or token is not None or key != last:
                    done()
                    pending = []
                if block != at:
                    at, own = block, {}
                if token is not None:
                    own[token] = number
                    continue
                last = key
                pending.append(texts)
            if out:
                yield made(keys, out, kind)
        if pending:
            rest = _ids_of_key(pending, len(names), ids)
            yield made([last] * len(rest), rest, kind)

    return run


def encode_texts(rows: DataFrame, key: str, texts: dict[str, Column], vocab: DataFrame) -> DataFrame | None:
    """``key`` and an array of ids for each of the ``texts``; None if a token has several ids.

    Every worker holds the ids of the ``HELD_TOKENS`` most common tokens. A block of rows asks for those of its other tokens once, and the
    answers come to it with its texts. So a row for each token is never made, and texts whose keys are all different
    are not even shuffled if the whole vocabulary is held.
    """
    if (known := token_ids(vocab)) is None:
        return None
    table, others = known
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(table)
    names = [f"_t{k}" for k in range(len(texts))]
    own = rows.select(F.col(key).alias("key"), *[t.alias(n) for n, t in zip(names, texts.values())])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = own.schema["key"].dataType.simpleString()
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("token", "string"), ("id", "int"))]
    if others is None:
        laid = own.select(F.lit(0).cast("long").alias("block"), *nothing, "key", *names)
        if scale.repeated(own, "key"):
            laid = scale.spread(laid, "key").sortWithinPartitions("key")
    else:
        own = own.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(BLOCKS * partitions)))
        asked = own.select("block", *names).mapInArrow(_asked(held, names), "block long, token string")
        answers = asked.join(others, "token").select("block", "token", "id")
        none = [F.lit(None).cast(kind).alias("key"), *[F.lit(None).cast("string").alias(n) for n in names]]
        both = answers.select("block", "token", "id", *none).unionByName(own.select("block", *nothing, "key", *names))
        # in a block the answers come first
        laid = scale.spread(both, "block").sortWithinPartitions("block", F.col("token").isNull(), "key")
    schema = ", ".join([f"key {kind}", *(f"ids{k} array<int>" for k in range(len(names)))])
    found = laid.mapInArrow(_encoded(held, names), schema)
    return found.select(F.col("key").alias(key), *[F.col(f"ids{k}").alias(n) for k, n in enumerate(texts)])


def encode_ids(rows: DataFrame, key: str, txt: Column, vocab: DataFrame, name: str) -> DataFrame:
    """``key, name array<int>``; unknown tokens become <unk>, a blank or null text has no ids.

    ``vocab`` comes from ``weighted``.
    """
    if (found := encode_texts(rows, key, {name: txt}, vocab)) is not None:
        return found
    toks = text.ws_tokens(txt)
    blank = without_cells(rows, key, toks, name, F.array().cast("array<int>"))
    cells = explode_windows(rows, [key], toks, 1).withColumnRenamed("w0", "token")
    found = scale.lookup_join(cells, vocab.select("token", "id", "cnt"), ["token"], "cnt", "left")
    cell = F.struct("i", F.coalesce("id", F.lit(UNK)).alias("id"))
    ids = (
        found.groupBy(key)
        .agg(F.sort_array(F.collect_list(cell)).alias("cells"))
        .select(key, F.col("cells.id").alias(name))
    )
    return ids.unionByName(blank)


def encode_pairs(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``pair_id, src_ids, tgt_ids``: sources end in <eos>, targets are wrapped in <sos> and <eos>."""
    vocab = weighted(vocab)
    texts = {"src_ids": text.append_eos(F.col("src")), "tgt_ids": text.wrap_target(F.col("tgt"))}
    if (found := encode_texts(pairs.filter("pair_id IS NOT NULL"), "pair_id", texts, vocab)) is not None:
        return found
    src, tgt = (encode_ids(pairs, "pair_id", t, vocab, name) for name, t in texts.items())
    return src.join(tgt, "pair_id")


def decode_ids(encoded: DataFrame, key: str, ids: str, vocab: DataFrame) -> DataFrame:
    """``key, txt``: tokens joined by a space, without <sos> and <eos>; no ids give an empty text."""
    vocab = weighted(vocab)
    blank = without_cells(encoded, key, F.col(ids), "txt", F.lit(""))
    if (table := held_table(vocab, "id", "token")) is not None:
        words = {k: v for k, v in table.items() if v is not None and k not in (SOS, EOS)}
        found = _held(encoded, words, lambda of, words: [words.get(x) for x in of], "array<string>")
        copies = _copies(encoded.filter(F.size(ids) > 0).select(key, F.col(ids).alias("_of")), key)
        return copies.select(key, F.array_join(F.array_compact(found("_of")), " ").alias("txt")).unionByName(blank)
    cells = encoded.select(key, F.posexplode(ids).alias("i", "id"))
    found = scale.lookup_join(cells, vocab.select("id", "token", "cnt"), ["id"], "cnt", "left")
    token = F.when(~F.col("id").isin(SOS, EOS), F.col("token"))
    decoded = (
        found.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("i", token.alias("token")))).alias("cells"))
        .select(key, F.array_join(F.array_compact(F.col("cells.token")), " ").alias("txt"))
    )
    return decoded.unionByName(blank)


def oov_rate(encoded: DataFrame, ids: str, group: str) -> DataFrame:
    """Share of <unk> among the ids of each group."""
    unknown = F.size(F.filter(ids, lambda x: x == UNK))
    return encoded.groupBy(group).agg(
        F.sum(F.size(ids)).alias("tokens"),
        F.sum(unknown).alias("unknown"),
        (F.sum(unknown) / F.sum(F.size(ids))).alias("oov_rate"),
    )


def align_vectors(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``id, token, vec`` for every id, zeros where no vector is given.

    A word outside the vocabulary stands for <unk>; of several vectors of an id the last line wins.
    """
    ids = vectors.join(
        vocab.select(F.col("token").alias("word"), "id"), "word", "left"
    ).withColumn("id", F.coalesce("id", F.lit(UNK)))
    last = ids.groupBy("id").agg(F.max_by("vec", "line_no").alias("vec"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return vocab.join(last, "id", "left").select("id", "token", F.coalesce("vec", zeros).alias("vec"))


def perplexity(log_probs: DataFrame) -> DataFrame:
    """exp of the mean negative log probability; <pad> and <sos> do not count."""
    used = log_probs.filter(~F.col("token").isin(SPECIALS[PAD], SPECIALS[SOS]))
    return used.agg(
        F.count(F.lit(1)).alias("tokens"), F.exp(-F.sum("log_p") / F.count(F.lit(1))).alias("perplexity")
    )
