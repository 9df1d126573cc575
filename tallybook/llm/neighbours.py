"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree hashes a vector to a long string of bits, the signs of its products
with random directions, and keeps the strings of its vectors sorted. A query
descends in every tree to the longest prefix that any vector shares with it.
From there all trees ascend together, one bit at a time: at each level a tree
offers the run of vectors with the query's prefix of that length. The ascent
stops at the first level where all trees together offer enough; whole levels
are taken, so equal prefixes never compete. The candidates are then ranked by
exact cosine on the original vectors in double precision.

Scale: vectors are dealt to shards of bounded size by a hash of their id, and a
shard's forest lives in one task; queries are dealt to blocks, and each block
visits each shard. A task thus holds a shard and a block, whatever the table's
size, and returns ``k`` rows for each query. Equal vectors spread over shards
like others. The share of a shard that is ranked is a parameter that sets the
recall; on vectors without structure, as random ones, 0.95 takes two fifths.

No part is taken by: null ids; vectors that are null, empty, zero, or hold a
null or non-finite component. Vectors of another length than the query's are no
candidates. Rows of equal id: the smallest vector, in the order of arrays,
stands. Fewer than ``k`` candidates: all. Ties go to the smaller id. Empty
table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import quoted
from tallybook.session import stored

SHARD_ROWS = 8192
BLOCK_ROWS = 4096
TREES = 128
BITS = 24
#: Offers, counted once for each tree, that end the ascent, as a share of the shard's rows.
SHARE = 0.45
LEAST_OFFERS = 512
SEED = 11


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v, size): vectors that have a direction, one for each id."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(quoted(vec_id).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .withColumn("size", F.size("v"))
    )


def hash_strings(vectors: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """Strings as numbers of ``bits`` bits, (trees, vectors)."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    out = np.empty((trees, len(vectors)), np.int64)
    for t in range(trees):
        out[t] = (vectors @ rng.standard_normal((vectors.shape[1], bits)) > 0) @ weights
    return out


class Forest:
    """Sorted hash strings of the vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, bits: int, seed: int):
        self.ids, self.vectors, self.trees, self.bits, self.seed = ids, vectors, trees, bits, seed
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        strings = hash_strings(vectors / self.norms[:, None], trees, bits, seed)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def ascend(self, queries: np.ndarray, enough: float) -> tuple[np.ndarray, np.ndarray]:
        """Runs [low, high) of each tree, (trees, queries), at the level where each query's ascent ends."""
        strings = hash_strings(queries, self.trees, self.bits, self.seed)
        low, high = np.zeros_like(strings), np.zeros_like(strings)
        open_ = np.arange(len(queries))
        for left_out in range(self.bits + 1):
            if not len(open_):
                break
            start = strings[:, open_] >> left_out << left_out
            a, b = np.empty_like(start), np.empty_like(start)
            for t in range(self.trees):
                a[t] = np.searchsorted(self.sorted[t], start[t])
                b[t] = np.searchsorted(self.sorted[t], start[t] + (1 << left_out))
            done = (b - a).sum(axis=0) >= enough if left_out < self.bits else np.ones(len(open_), bool)
            low[:, open_[done]], high[:, open_[done]] = a[:, done], b[:, done]
            open_ = open_[~done]
        return low, high

    def nearest(self, query_id: int, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``k`` best candidates."""
        offered = np.zeros(len(self.ids), bool)
        for t in range(self.trees):
            offered[self.order[t, low[t] : high[t]]] = True
        others = self.ids != query_id
        offered &= others
        if offered.sum() < k:
            offered = others
        at = np.flatnonzero(offered)
        near = (self.vectors[at] @ query) / self.norms[at]
        if len(at) > k:
            # Some slack, as sums in another order may tell equal vectors apart.
            edge = np.partition(near, -k)[-k]
            at = at[near >= edge - 1e-9 * abs(edge) - 1e-12 * np.abs(near).max()]
        cosine = (self.vectors[at] * query).sum(axis=1) / (self.norms[at] * np.sqrt((query * query).sum()))
        best = np.lexsort((self.ids[at], -cosine))[:k]
        return self.ids[at[best]], cosine[best]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    trees: int = TREES,
    bits: int = BITS,
    share: float = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of which ``is_query`` (on column ``id``) holds, against all others."""
    rows = stored(usable(vectors, vec_id, vector))
    asked = rows.filter(is_query)
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(asked.count() / BLOCK_ROWS))
    spot = F.xxhash64("id")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = rows.withColumn("shard", F.pmod(spot, F.lit(shards)).cast("int")).withColumn("block", each(blocks))
    queries = asked.withColumn("block", F.pmod(spot, F.lit(blocks)).cast("int")).withColumn("shard", each(shards))

    def visit(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(index) and len(queries):
            ids = index["id"].to_numpy()
            forest = Forest(ids, np.stack(index["v"].tolist()).astype(float), trees, bits, seed)
            asked = np.stack(queries["v"].tolist()).astype(float)
            low, high = forest.ascend(asked, max(share * len(ids), LEAST_OFFERS))
            for i, q in enumerate(queries["id"].tolist()):
                near, cosine = forest.nearest(q, asked[i], low[:, i], high[:, i], k)
                found.append(pd.DataFrame({"query_id": q, "vec_id": near, "score": cosine}))
        if found:
            return pd.concat(found)
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    tile = ["size", "shard", "block"]
    met = index.groupBy(*tile).cogroup(queries.groupBy(*tile)).applyInPandas(visit, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
