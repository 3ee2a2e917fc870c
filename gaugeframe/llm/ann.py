"""Approximate nearest neighbours by a hash-prefix forest.

Every tree hashes a vector to a long bit string (signs of random projections) and keeps the
strings in a sorted array; strings that share a prefix with a query's stand together, so a
tree's nodes are ranges found by binary search.  A query descends in every tree to its
longest match, of whatever length; then all trees ascend together, one bit at a time, and
give the rows of ever larger ranges, until the trees together have found ``found`` times as
many matches as there are rows, and enough different rows.  What a row shares with the query
is the sum of its matched prefix lengths over the trees; the rows that share most are
measured exactly: ``k`` times the square root of the number of rows, at every size.

Rows are dealt by place into shards of about ``shard_rows``, so equal rows or ids make no
shard larger.  A shard's task reads its rows, builds its forest once, and streams all queries
(a stated query set) through it in batches; it returns at most ``k`` rows a query, and the
best ``k`` over all shards follow.  A task holds one shard and one batch.  Equal vectors share
their strings in every tree, so they come together, the smallest ids first.

Measured recall and share of rows measured: see the README.

Defined cases: vectors that are null, zero, of another dimension than most (the commonest
dimension is the table's) or hold null or non-finite components take no part; rows with a
null id don't either; every row is a query or candidate of its own, so repeated rows find
each other, and rows that share a query's id give a list each; equal distances go to the
smaller id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship

BITS = 32


class HashPrefixForest:
    """Sorted arrays of bit strings, one a tree."""

    def __init__(self, x: np.ndarray, trees: int, seed: int = 11):
        self.x, self.trees = x, trees
        self.planes = np.random.default_rng(seed).normal(size=(x.shape[1], trees * BITS)).astype(np.float32)
        keys = self.hashes(x)
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, axis=1).astype(np.uint32)

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """trees x rows of bit strings as integers, first bit highest."""
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        out = np.empty((self.trees, len(x)), np.int64)
        for a in range(0, len(x), 2048):
            bits = (x[a : a + 2048].astype(np.float32) @ self.planes > 0).reshape(-1, self.trees, BITS)
            out[:, a : a + 2048] = (bits @ weights).T
        return out

    def ranges(self, keys: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """trees x queries: where the strings begin and end that share all bits but the last ``up`` (per query)."""
        low = (keys >> up) << up
        high = low + (np.int64(1) << up) - 1
        first = np.stack([np.searchsorted(k, v.astype(np.uint32), "left") for k, v in zip(self.keys, low, strict=True)])
        return first, np.stack([np.searchsorted(k, v.astype(np.uint32), "right") for k, v in zip(self.keys, high, strict=True)])

    def stops(self, keys: np.ndarray, enough: int) -> np.ndarray:
        """Per query the bits by which all trees have ascended when they first hold ``enough`` matches
        together.  Matches only grow on the way up, so the level is found by halving."""
        low, high = np.zeros(keys.shape[1], np.int64), np.full(keys.shape[1], BITS, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            a, z = self.ranges(keys, middle)
            met = (z - a).sum(0) >= enough
            low, high = np.where(met, low, middle + 1), np.where(met, middle, high)
        return low

    def shared(self, key: np.ndarray, up: int) -> np.ndarray:
        """Per row the summed lengths of the prefixes, longer than the level's, that it shares with the
        string ``key`` in each tree, counted from the level; 0: not found."""
        a, z = (r[:, 0] for r in self.ranges(key[:, None], np.array([up])))
        sizes = z - a
        at = np.arange(sizes.sum()) + np.repeat(np.arange(self.trees) * len(self.x) + a - (np.cumsum(sizes) - sizes), sizes)
        differ = self.keys.reshape(-1)[at] ^ np.repeat(key.astype(np.uint32), sizes)
        length = up + 1 - np.frexp(differ.astype(np.float64))[1]  # the exponent is the bit length
        return np.bincount(self.order.reshape(-1)[at], length, len(self.x))

    def candidates(self, key: np.ndarray, up: int, most: int) -> np.ndarray:
        """The ``most`` rows that share most with a query, which may be all; ties to the first rows.
        Ascends from ``up`` until so many rows are found."""
        n = len(self.x)
        most = min(most, n)
        while True:
            share = self.shared(key, up)
            if up == BITS or np.count_nonzero(share) >= most:
                break
            up += 1
        rank = np.arange(n) - share * n
        return np.sort(np.argpartition(rank, most - 1)[:most]) if most < n else np.arange(n)


def measured(n: int, k: int) -> int:
    """Rows that are measured exactly for a query among ``n``."""
    return math.ceil(k * math.sqrt(n))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt((d * d).sum(1))


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    dim = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (dim[0].n if dim else 0))


class Shard:
    """A shard's rows, then its forest."""

    def __init__(self, trees: int, found: float, k: int):
        self.trees, self.found, self.k, self.parts, self.forest = trees, found, k, [], None

    def add(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((rows, ids, x))

    def search(self, rows: np.ndarray, q: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query row, ids, distances) of each query's nearest rows found, but itself."""
        if not self.parts:
            return []
        if self.forest is None:
            self.rows, self.ids, x = (np.concatenate(p) for p in zip(*self.parts, strict=True))
            self.parts = [None]
            self.forest = HashPrefixForest(x, self.trees)
        n, k, out = len(self.ids), self.k, []
        keys = self.forest.hashes(q)
        stops = self.forest.stops(keys, math.ceil(self.found * n))
        for j in range(len(q)):
            near = self.forest.candidates(keys[:, j], int(stops[j]), measured(n, k))
            near = near[self.rows[near] != rows[j]]
            d = distances(self.forest.x[near], q[j])
            best = np.lexsort((self.ids[near], d))[:k]
            out.append((rows[j], self.ids[near[best]], d[best]))
        return out


def search(vectors: DataFrame, id_col="vec_id", vec_col="embedding", every=100, k=10, trees=128, found=4.0, shard_rows=65536) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found to each row whose id is divisible
    by ``every``."""
    ship(vectors.sparkSession)
    v = materialise(valid(vectors, id_col, vec_col))
    shards = max(1, -(-v.count() // shard_rows))
    # a written row's place is the same whenever it is read again
    v = v.withColumn("row", F.monotonically_increasing_id())
    data = v.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("asks", F.lit(False))
    asked = v.where(F.col("vec_id") % every == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
    both = data.unionByName(asked).select("shard", "asks", "row", "vec_id", "v")
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", "asks", "vec_id")  # rows first, then the queries

    def run(batches):
        number, shard = None, None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if number != kind[a] // 2:
                    number, shard = kind[a] // 2, Shard(trees, found, k)
                rows, ids = (b.column(i).slice(a, z - a).to_numpy() for i in (2, 3))
                x = b.column(4).slice(a, z - a).flatten().to_numpy().reshape(z - a, -1)
                if not kind[a] % 2:
                    shard.add(rows, ids, x)
                    continue
                hits = shard.search(rows, x)
                names = dict(zip(rows.tolist(), ids.tolist(), strict=True))
                size = [len(i) for _, i, _ in hits]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([r for r, _, _ in hits], size), pa.int64()), pa.array(np.repeat([names[r] for r, _, _ in hits], size), pa.int64()),
                    pa.array(np.concatenate([i for _, i, _ in hits] or [[]]), pa.int64()), pa.array(np.concatenate([d for _, _, d in hits] or [[]]), pa.float64()),
                ], names=["row", "query_id", "vec_id", "score"])

    hits = both.mapInArrow(run, "row long, query_id long, vec_id long, score double")
    w = Window.partitionBy("row").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
