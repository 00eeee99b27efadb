"""Near-duplicate vectors by random-hyperplane signs, exact cosines and connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleops.llm.common import narrow, partitions, regrouped, runs, small_batches, written
from styleops.llm.components import components

THRESHOLD = 0.95
#: The chance that a pair just at the threshold meets in no table.
MISS = 1e-3
#: Vectors compared at once; a larger bucket is split and its blocks are compared pairwise.
BLOCK = 1024
SEED = 20


def plan(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a sign key and number of tables: about 16 random vectors share a key at any table size."""
    bits = min(30, max(6, math.ceil(math.log2(max(rows, 16) / 16))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row's content key, null for vectors that link with nothing."""
    for rows in batches:
        keys = []
        for vec in rows["embedding"]:
            data = None if vec is None else np.asarray([np.nan if x is None else x for x in vec], dtype=np.float64)
            good = data is not None and data.size and np.isfinite(data).all() and np.isfinite(n := np.linalg.norm(data)) and n > 0
            keys.append(hashlib.blake2b(data.tobytes(), digest_size=16).hexdigest() if good else None)
        yield pd.DataFrame({"vec_id": rows["vec_id"].astype("Int64"), "node": keys, "embedding": rows["embedding"]})


def _signed(bits: int, tables: int):
    weights = (1 << np.arange(bits, dtype=np.int64))[None, None, :]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, part in rows.groupby(rows["embedding"].map(len)):
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                signs = (x @ _planes(dim, bits, tables)) > 0
                keys = (signs.reshape(len(x), tables, bits) * weights).sum(axis=2)
                yield pd.DataFrame({"node": part["node"], "size": part["size"], "embedding": part["embedding"], "dim": dim, "keys": list(keys)})

    return run


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of ``n`` indices, by repeated minimum over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compared(threshold: float):
    """Links inside runs of rows with the same (table, dim, key, i, j): per vector its partners and one edge."""

    def run_of(rows: pd.DataFrame) -> pd.DataFrame | None:
        if len(rows) < 2:
            return None
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        t, i, j = (int(rows[c].iloc[0]) for c in ("table", "i", "j"))
        block = rows["block"].to_numpy()
        ours, theirs = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.nonzero(x[ours] @ x[theirs].T >= threshold)
        a, b = ours[a], theirs[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        if t and len(a):
            keys = np.stack(rows["keys"].to_numpy())[:, :t]
            for at in range(0, len(a), 1 << 16):  # pairs that met in an earlier table were counted there
                part = slice(at, at + (1 << 16))
                fresh = ~(keys[a[part]] == keys[b[part]]).any(axis=1)
                a[part], b[part] = np.where(fresh, a[part], -1), np.where(fresh, b[part], -1)
            a, b = a[a >= 0], b[b >= 0]
        if not len(a):
            return None
        size = rows["size"].to_numpy()
        n_links = np.zeros(len(rows), np.int64)
        np.add.at(n_links, a, size[b])
        np.add.at(n_links, b, size[a])
        linked = n_links > 0
        nodes = rows["node"].to_numpy()
        return pd.DataFrame({"node": nodes[linked], "n_links": n_links[linked], "other": nodes[_roots(len(rows), a, b)[linked]]})

    names = ["table", "dim", "key", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches, names):
            if (found := run_of(rows)) is not None:
                yield found

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    Equal vectors are one class first, so a hot vector is compared once. Classes meet in ``tables``
    of sign keys; a pair that meets is verified by its cosine in double precision and counted in
    the first table where it meets. Buckets above ``block`` classes are cut into blocks by a hash
    and every pair of blocks is compared, so none is capped. Inside a bucket only counts and one
    edge for each linked vector are produced, never its pairs.

    A vector that is null, empty or zero, or holds a null or non-finite component, links with
    nothing; vectors of different lengths don't link either. Repeated rows count as other vectors.
    A row with a null ``vec_id`` takes part in links; it is kept only if its component has no id.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    base = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = written(base.mapInPandas(_keyed, "vec_id long, node string, embedding array<double>"), "vectors")
    good = rows.filter(F.col("node").isNotNull())
    classes = good.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("embedding").alias("embedding"))
    classes = written(narrow(classes), "vector-classes")
    bits, tables = plan(classes.count(), threshold)
    signed = written(
        classes.mapInPandas(_signed(bits, tables), "node string, size long, embedding array<double>, dim int, keys array<long>"),
        "signed-vectors",
    )
    met = signed.select("node", "dim", F.posexplode("keys").alias("table", "key"))
    counts = met.groupBy("table", "dim", "key").count().filter("count > 1")
    buckets = written(narrow(counts.select("table", "dim", "key", F.ceil(F.col("count") / block).alias("blocks"))), "buckets")
    laid = (
        signed.select("*", F.posexplode("keys").alias("table", "key"))
        .join(buckets, ["table", "dim", "key"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        .select(
            "node", "size", "embedding", "keys", "table", "dim", "key", "block",
            F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
        )
    )
    run = ["table", "dim", "key", "i", "j"]
    met_in = laid.repartition(max(partitions(spark), 16), *run).sortWithinPartitions(*run)
    found = met_in.mapInPandas(_compared(threshold), "node string, n_links long, other string")
    found = written(regrouped(found), "vector-links")
    links = found.groupBy("node").agg(F.sum("n_links").alias("more"))
    parts = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = (
        classes.select("node", "size")
        .join(links, "node", "left")
        .join(parts, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"), (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    )
    named = written(narrow(named), "named-classes")
    smallest = (
        good.groupBy("node").agg(F.min("vec_id").alias("least"))
        .join(named, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    )
    per_class = written(narrow(named.join(smallest, "component").select("node", "n_links", "component_id")), "classes-of-vectors")
    joined = rows.select("vec_id", "node").join(per_class, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )
