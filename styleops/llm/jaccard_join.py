"""Similarity join of n-gram sets: global order by rarity, prefix candidates, tries inside candidate groups."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleops.llm.common import (
    as_row, blob, blocks, content_digest, narrow, partitions, regrouped, row_columns, runs, small_batches, total_bytes, unblob, whole_text, written,
)
from styleops.llm.components import components

WORDS = 5
#: Text handed on at once, and all text for one bucket of shingles.
BLOCK_CHARS = 2_000_000
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 64
#: Words whose hashes one worker remembers; longer words are not remembered.
MEMO_WORDS, MEMO_BYTES = 100_000, 48
#: Sets joined in one trie; a larger candidate group is cut into blocks that are joined pairwise.
BLOCK_SETS = 1000
KEY = np.dtype([("high", "<u8"), ("low", "<u8")])
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BLOBS = "bucket long, ids binary, keys binary, sizes binary, counts binary, grams binary"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS and len(word) < MEMO_BYTES:
            self[word] = made
        return made


_hashes = _WordHashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams; A-Z are lower-cased, ASCII white space parts words."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(_hashes) >= MEMO_WORDS:
        _hashes.clear()
    each = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(words, len(found))
    total = np.full(len(found) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * _FACTOR + each[k : len(found) - width + 1 + k]
    for shift in (32, 29):
        total = (total ^ (total >> np.uint64(shift))) * _MIX
    return np.unique(total ^ (total >> np.uint64(32)))


def _sets(buckets: int, words: int):
    """Rows of bucket -1: which row has which set, and the digest of its text. Others: the grams of each distinct set that fall into a bucket."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in blocks(batches, "norm", BLOCK_CHARS):
            known: dict[bytes, int] = {}
            sets, keys, sizes = [], [], []
            for text in rows["norm"].tolist():
                grams = shingles(text, words)
                data = grams.tobytes()
                key = hashlib.blake2b(data, digest_size=16).digest()
                keys.append(key)
                sizes.append(len(grams))
                if key not in known and len(grams):
                    known[key] = len(sets)
                    sets.append(grams)
            missing = rows["doc_id"].isna().to_numpy()
            ids = rows["doc_id"].fillna(0).astype("int64").to_numpy()
            out = [(-1, blob(ids, "<i8"), b"".join(keys), blob(sizes, "<u4"), blob(missing, "<u4"), b"".join(rows["content"]))]
            if sets:
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                grams = np.concatenate(sets)
                own_keys, own_sizes = np.frombuffer(b"".join(known), dtype=KEY), np.asarray([len(s) for s in sets])
                bucket = (grams >> shift).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    have, counts = np.unique(owner[part], return_counts=True)
                    out.append(
                        (int(bucket[part[0]]), b"", own_keys[have].tobytes(), blob(own_sizes[have], "<u4"), blob(counts, "<u4"), blob(grams[part], "<u8"))
                    )
            yield pd.DataFrame(out, columns=["bucket", "ids", "keys", "sizes", "counts", "grams"])

    return run


def _first_of_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first index of each distinct key, and for each key the number of its group."""
    order = np.lexsort((np.arange(len(keys)), keys["low"], keys["high"]))
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return order[fresh], group


def _shared(cells: int):
    """The grams of a bucket that two or more distinct sets have, ranked and grouped by the cell of their set.

    A gram's rank is its place in the global order: the power of two below its number of sets in the
    upper six bits, then its hash.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "ids", "keys", "sizes", "counts", "grams"]
        if rows["bucket"].iloc[0] < 0:
            return rows[names]
        keys, sizes = unblob(rows["keys"], KEY), unblob(rows["sizes"], "<u4")
        counts, grams = unblob(rows["counts"], "<u4"), unblob(rows["grams"], "<u8")
        first, _ = _first_of_each(keys)
        once = np.zeros(len(keys), dtype=bool)
        once[first] = True
        owner = np.repeat(np.arange(len(keys)), counts)
        used = once[owner]
        owner, grams = owner[used], grams[used]
        order = np.argsort(grams, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(grams[order]) != 0, True))
        frequency = np.repeat(np.diff(ends, prepend=-1), np.diff(ends, prepend=-1))
        several = frequency > 1
        owner, grams, frequency = owner[order][several], grams[order][several], frequency[several]
        if not len(owner):
            return pd.DataFrame(columns=names)
        power = np.floor(np.log2(frequency)).astype(np.uint64)
        rank = (power << np.uint64(58)) | (grams >> np.uint64(6))
        cell = (keys["low"][owner] % np.uint64(cells)).astype(np.int64)
        order = np.lexsort((owner, cell))
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            have, n = np.unique(owner[part], return_counts=True)
            out.append((int(cell[part[0]]), b"", keys[have].tobytes(), blob(sizes[have], "<u4"), blob(n, "<u4"), blob(rank[part], "<u8")))
        return pd.DataFrame(out, columns=names)

    return run


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """The ordered shared grams of each set of a cell that shares enough of them to have a partner."""
    keys, sizes = unblob(rows["keys"], KEY), unblob(rows["sizes"], "<u4")
    counts, grams = unblob(rows["counts"], "<u4"), unblob(rows["grams"], "<u8")
    first, group = _first_of_each(keys)
    shared = np.bincount(group, weights=counts).astype(np.int64)
    size = sizes[first].astype(np.int64)
    enough = 100 * shared >= 80 * size
    owner = np.repeat(group, counts)
    kept = enough[owner]
    owner, grams = owner[kept], grams[kept]
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    parts = np.split(grams, starts[1:]) if len(grams) else []
    of = owner[starts] if len(grams) else np.empty(0, np.int64)
    return pd.DataFrame(
        {"node": [keys[first[g]].tobytes() for g in of], "size": size[of], "grams": [blob(p, "<u8") for p in parts]}, columns=["node", "size", "grams"]
    )


def prefix_length(size: int, shared: int) -> int:
    """How many of a set's shared grams, rarest first, one of which any partner has in its own prefix.

    A partner has ceil(0.8 * size) grams in common, so of the first size - ceil(0.8 * size) + 1 grams
    in the global order one is common; grams that no other set has come first and need no index.
    """
    return size - -(-4 * size // 5) + 1 - (size - shared)


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        heads = [np.frombuffer(g, dtype="<i8")[: prefix_length(n, len(g) // 8)] for n, g in zip(rows["size"].tolist(), rows["grams"], strict=True)]
        if heads:
            nodes = np.repeat(rows["node"].to_numpy(), [len(h) for h in heads])
            yield pd.DataFrame({"gram": np.concatenate(heads), "node": nodes})


class _Branch:
    """A run of grams that some sets share, with bounds over the sets below it."""

    __slots__ = ("grams", "below", "sets", "least", "most", "longest", "one", "alike")

    def __init__(self, grams: np.ndarray):
        self.grams, self.below, self.sets = grams, {}, []
        self.least, self.most, self.longest = sys.maxsize, 0, 0
        self.one, self.alike = -1, True

    def cut(self, at: int) -> None:
        """Keep the first ``at`` grams here and hang the rest below."""
        tail = _Branch(self.grams[at:])
        tail.below, tail.sets, tail.least, tail.most, tail.longest, tail.one, tail.alike = (
            self.below, self.sets, self.least, self.most, self.longest, self.one, self.alike,
        )
        self.grams, self.below, self.sets = self.grams[:at], {int(tail.grams[0]): tail}, []
        self.longest += len(tail.grams)


def trie_links(sets: list[np.ndarray], sizes: list[int]) -> list[int]:
    """For each set the smallest-numbered set of its group, groups being joined by Jaccard 0.8 or more.

    Sets go into a trie in the order of their sizes. Before a set is added, the trie is walked with
    the overlap counted along each branch once for all sets below. A branch is left when even all that
    remains, of the set or of the longest one below, gives too small an overlap with the smallest
    size below, when all sizes below are too small, or when all sets below are in the set's group already.
    """
    root_of = list(range(len(sets)))

    def find(k: int) -> int:
        while root_of[k] != k:
            root_of[k] = root_of[root_of[k]]
            k = root_of[k]
        return k

    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    local = np.split(places, np.cumsum([len(s) for s in sets])[:-1])
    mark = np.zeros(len(values), dtype=bool)
    top = _Branch(np.empty(0, np.int64))
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(sets) + 1000))

    def walk(branch: _Branch, overlap: int, me: int, mine: np.ndarray) -> None:
        size = sizes[me]
        if 5 * branch.most < 4 * size or (branch.alike and branch.one >= 0 and find(branch.one) == find(me)):
            return
        left = len(mine)
        if len(branch.grams):
            overlap += int(np.count_nonzero(mark[branch.grams]))
            left -= int(np.searchsorted(mine, branch.grams[-1], side="right"))
        if 9 * (overlap + min(left, branch.longest)) < 4 * (size + branch.least):
            return
        for other in branch.sets:
            if 9 * overlap >= 4 * (size + sizes[other]):
                a, b = find(me), find(other)
                root_of[max(a, b)] = min(a, b)
        for child in branch.below.values():
            walk(child, overlap, me, mine)
        seen = {find(k) for k in branch.sets} | {find(c.one) if c.alike else -1 for c in branch.below.values()}
        branch.alike = len(seen) == 1 and -1 not in seen

    def note(branch: _Branch, me: int, remaining: int) -> None:
        branch.least, branch.most = min(branch.least, sizes[me]), max(branch.most, sizes[me])
        branch.longest = max(branch.longest, remaining)
        if branch.one < 0:
            branch.one = me
        elif branch.alike and find(branch.one) != find(me):
            branch.alike = False

    def add(me: int, mine: np.ndarray) -> None:
        branch, at = top, 0
        note(top, me, len(mine))
        while at < len(mine):
            child = branch.below.get(int(mine[at]))
            if child is None:
                child = branch.below[int(mine[at])] = _Branch(mine[at:])
                at = len(mine)
            else:
                n = min(len(child.grams), len(mine) - at)
                differ = np.flatnonzero(child.grams[:n] != mine[at : at + n])
                n = int(differ[0]) if len(differ) else n
                if n < len(child.grams):
                    child.cut(n)
                at += n
            note(child, me, len(mine) - at)
            branch = child
        branch.sets.append(me)

    for me in sorted(range(len(sets)), key=lambda k: (sizes[k], k)):
        mark[local[me]] = True
        walk(top, 0, me, local[me])
        mark[local[me]] = False
        add(me, local[me])
    return [find(k) for k in range(len(sets))]


GROUP = ["component", "low_class", "low_block", "high_class", "high_block"]


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in runs(batches, GROUP):
        if len(rows) < 2:
            continue
        nodes = rows["node"].to_numpy()
        roots = trie_links([np.frombuffer(g, dtype="<u8") for g in rows["grams"]], rows["size"].tolist())
        linked = [k for k, r in enumerate(roots) if r != k]
        if linked:
            yield pd.DataFrame({"u": nodes[linked], "v": nodes[[roots[k] for k in linked]]})


def _laid_out(sets: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """Each set once for every pair of blocks it is joined in; a group of up to ``block`` sets is one block.

    Sizes of linked sets differ by a quarter at most, so in a larger group a size class is joined
    with itself and its neighbours only.
    """
    size_class = F.floor(F.log("size") / F.log(F.lit(1.25))).cast("int")
    rows = written(sets.join(groups, "node").withColumn("class", size_class), "candidate-sets")
    classes = rows.groupBy("component", "class").agg(F.count(F.lit(1)).alias("n"))
    whole = classes.groupBy("component").agg(F.sum("n").alias("all")).filter(F.col("all") > block)
    large = written(narrow(classes.join(whole, "component").select("component", "class", F.ceil(F.col("n") / block).cast("int").alias("blocks"))), "large-groups")
    for shift, name in ((0, "blocks"), (1, "above"), (-1, "below")):
        near = large.select("component", (F.col("class") - shift).alias("class"), F.col("blocks").alias(name))
        rows = rows.join(near, ["component", "class"], "left")
    here, mine = F.col("class"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def pair(a, b, c, d):
        return F.struct(*[x.cast("int").alias(n) for x, n in zip((a, b, c, d), GROUP[1:], strict=True)])

    def over(count: str, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array().cast("array<struct<low_class:int,low_block:int,high_class:int,high_block:int>>"))

    zero = F.lit(0)
    pairs = F.when(F.col("blocks").isNull(), F.array(pair(zero, zero, zero, zero))).otherwise(
        F.concat(
            over("blocks", lambda j: pair(here, F.least(F.col("mine"), j), here, F.greatest(F.col("mine"), j))),
            over("above", lambda j: pair(here, F.col("mine"), here + 1, j)),
            over("below", lambda j: pair(here - 1, j, here, F.col("mine"))),
        )
    )
    return rows.withColumn("mine", mine).select("component", "node", "size", "grams", F.explode(pairs).alias("p")).select("component", "node", "size", "grams", "p.*")


def _joined_sets(docs: DataFrame, words: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, content, node, n_shingles`` of every row, and ``node, least, component`` of every set: its smallest id and the name of its group."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = max(LEAST_BUCKETS, 1 << (total_bytes(docs) // BUCKET_BYTES).bit_length())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_digest().alias("content"), whole_text().alias("norm"))
    sent = base.mapInPandas(_sets(buckets, words), BLOBS)
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("keys"), F.lit(buckets)))
    shared = written(sent.withColumn("bucket", spread).groupBy("bucket").applyInPandas(_shared(buckets), BLOBS), "shared-grams")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keys, contents = b"".join(rows["keys"]), b"".join(rows["grams"])
            ids = pd.array(unblob(rows["ids"], "<i8").copy(), dtype="Int64")
            ids[unblob(rows["counts"], "<u4") > 0] = pd.NA
            nodes = [keys[k : k + 16] for k in range(0, len(keys), 16)]
            digests = [contents[k : k + 32] for k in range(0, len(contents), 32)]
            yield pd.DataFrame({"doc_id": ids, "content": digests, "node": nodes, "n_shingles": unblob(rows["sizes"], "<u4").astype("int64")})

    members = written(narrow(shared.filter("bucket < 0").mapInPandas(unpack, "doc_id long, content binary, node binary, n_shingles long")), "members")
    sets = written(shared.filter("bucket >= 0").groupBy("bucket").applyInPandas(_gather, "node binary, size long, grams binary"), "ordered-sets")
    heads = written(sets.mapInPandas(_prefixes, "gram long, node binary"), "prefix-grams")
    stars = heads.groupBy("gram").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "least")
    edges = heads.join(written(narrow(stars), "stars"), "gram").filter(F.col("node") != F.col("least")).select("node", "least").distinct()
    groups = components(edges)
    laid = _laid_out(sets, groups, block)
    met_in = laid.repartition(partitions(spark), *GROUP).sortWithinPartitions(*GROUP)
    links = written(regrouped(met_in.mapInPandas(_joined, "u binary, v binary")), "set-links")
    joined = components(links)
    per_set = members.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = per_set.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return members, written(narrow(named), "named-sets")


def jaccard_groups(docs: DataFrame, words: int = WORDS, block: int = BLOCK_SETS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: groups of texts linked by Jaccard 0.8 of their word n-grams.

    1. Rows with equal n-gram sets are one set. The grams of each distinct set go to buckets by hash,
       which find the grams that several sets have; a set of which less than four fifths is
       shared can have no partner. Grams are ordered by the number of sets they are in, rarest first.
    2. Sets that share a gram of their prefixes are candidates: each gram gives a star, not its pairs, and the
       connected components of the stars are candidate groups.
    3. Each group (or pair of blocks of a large one) is joined in a trie of its ordered sets; it
       gives one edge for each linked set. Components of these edges are the result.

    No link between different sets is lost and no pair is emitted. A text with fewer words than
    ``words`` has one gram, its whole sequence; a null text, or one without words, has none and is alone:
    its component is its own id. The smallest id of a group names it; null ids don't, so the component of rows
    with null ids only is null. Rows that repeat an id are rows of their own. Other columns are not read.
    """
    members, named = _joined_sets(docs, words, block)
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    own = written(narrow(named.join(smallest, "component").select("node", "component_id")), "components-of-sets")
    out = members.join(own, "node", "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies; all columns stay.

    It is the row with the smallest id, null ids last; of equal ids the one with the smallest digest of its text, of equal texts
    the one whose other columns come first as JSON. Texts without words are linked with nothing, so all their rows stay.
    """
    members, named = _joined_sets(docs, WORDS, BLOCK_SETS)
    rows = members.groupBy("doc_id", "content", "node", "n_shingles").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content", "rows")
    linked = rows.filter("n_shingles > 0").join(named.select("node", "component"), "node")
    first = linked.groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first.content", "first.rows")
    alone = rows.filter("n_shingles = 0").select("doc_id", "content", F.lit(1).cast("long").alias("rows"))
    kept = written(narrow(first.unionByName(alone)), "kept-rows")
    keyed = docs.select(as_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), content_digest().alias("digest"))

    def candidates(rows):
        same = (F.col("digest") == F.col("content")) & F.col("id").eqNullSafe(F.col("doc_id"))
        return keyed.join(kept.filter(rows), same, "left_semi")

    several = candidates("rows > 1").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return candidates("rows = 1").select("row").unionByName(several.select("row")).select(*row_columns(docs, "row"))
