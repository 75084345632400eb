"""Exact top-k inner products by MaxScore over sharded postings.

Every component of a vector is two terms: its positive and its negative part.  A query component
meets the term of its own sign with gain and the other with loss, so a term's bound in a shard is
the query weight times the largest posting value, and no term of loss can raise a score.  Terms
are taken by falling bound.  As long as the bounds of the rest can still lift an unseen vector
over the k-th score so far, the term is essential and its whole posting is traversed; the others
are probed only for candidates that stay competitive.  Shards and blocks of queries are
independent groups of bounded size; their best results are merged by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a shard and queries in a block.
SHARD_ROWS, BLOCK_ROWS = 2_048, 2_048
#: Candidates are thinned out after so many probed terms.
PROBES = 8
HIT = "query_id long, vec_id long, score long"


class Shard:
    """Postings of some vectors: for each component and sign, places by falling value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.columns = np.ascontiguousarray(self.values.T)
        self.postings = []
        for column in self.columns:
            own = []
            for sign in (1, -1):
                at = np.flatnonzero(sign * column > 0)
                at = at[np.argsort(-sign * column[at], kind="stable")]
                own.append((at, sign * column[at]))
            self.postings.append(own)

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score), larger score first, ties to the smaller id, without the query itself."""
        n, dims = len(self.ids), len(query)
        gains, bounds = [], []
        for d in range(dims):
            q = int(query[d])
            if q:
                at, value = self.postings[d][q < 0]
                gains.append((d, at, value))
                bounds.append(abs(q) * int(value[0]) if len(value) else 0)
        order = np.argsort(-np.array(bounds, np.float64), kind="stable")
        rest = np.append(np.cumsum([bounds[i] for i in order[::-1]])[::-1], 0) if bounds else np.zeros(1)
        own = np.flatnonzero(self.ids == query_id)
        floor = self._floor(query, [gains[i] for i in order[:4]], own, k)
        # Essential terms: a vector in none of them gains less than the k-th score known so far.
        essential = 0
        while essential < len(order) and (floor is None or rest[essential] >= floor):
            essential += 1
        partial, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        for i in order[:essential]:
            d, at, value = gains[i]
            partial[at] += abs(int(query[d])) * value
            seen[at] = True
        if floor is None or rest[min(essential, len(order))] >= floor or floor <= 0:
            seen[:] = True
        seen[own] = False
        left = np.flatnonzero(seen)
        partial = partial[left]
        if floor is not None:
            keep = partial + rest[essential] >= floor
            left, partial = left[keep], partial[keep]
        # Probe: the gains of the other terms, then the losses, strongest query weights first.
        probes = [(gains[i][0], True) for i in order[essential:]]
        probes += [(int(d), False) for d in np.argsort(-np.abs(query), kind="stable") if query[d]]
        for step, (d, gain) in enumerate(probes):
            if not len(left):
                return []
            product = int(query[d]) * self.columns[d][left]
            partial = partial + (np.maximum(product, 0) if gain else np.minimum(product, 0))
            if floor is not None and step % PROBES == PROBES - 1:
                more = rest[essential + step + 1] if essential + step + 1 <= len(order) else 0
                keep = partial + more >= floor
                left, partial = left[keep], partial[keep]
        top = np.lexsort((self.ids[left], -partial))[:k]
        return [(int(self.ids[left[i]]), int(partial[i])) for i in top]

    def _floor(self, query: np.ndarray, terms: list, own: np.ndarray, k: int) -> int | None:
        """k-th best score among vectors that lead the query's strongest postings, if there are k."""
        leaders = np.unique(np.concatenate([at[: 4 * k] for _, at, _ in terms])) if terms else np.zeros(0, np.int64)
        leaders = np.setdiff1d(leaders, own)
        if len(leaders) < k:
            return None
        scores = self.values[leaders] @ query
        return int(np.partition(scores, len(scores) - k)[len(scores) - k])


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """One integer vector per key: rows without key, vector or with a null or non-finite component
    take no part; of several rows of a key the smallest vector stands for it."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & finite)
    rows = rows.select("_id", F.transform("_v", lambda x: F.floor(x * scale).cast("long")).alias("_q"))
    return rows.groupBy("_id").agg(F.min("_q").alias("_q"))


def _numbers(n: int) -> F.Column:
    return F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")


def searched(vectors: DataFrame, is_query: F.Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """For each query row its k best other rows: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on the column ``_id``.  Scores are inner products of the components
    floor(scale * x) and must fit in a long; a shorter vector counts as filled up with zeros.  Ties
    go to the smaller id.  A query with fewer candidates returns all of them.
    """
    rows = quantised(vectors, key, vector, scale)
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    shard = (F.xxhash64("_id", F.lit(1)) % shards + shards) % shards
    block = (F.xxhash64("_id", F.lit(2)) % blocks + blocks) % blocks
    left = rows.withColumn("shard", shard).withColumn("block", F.explode(_numbers(blocks)))
    right = queries.withColumn("block", block).withColumn("shard", F.explode(_numbers(shards)))

    def matrix(frame: pd.DataFrame, width: int) -> np.ndarray:
        out = np.zeros((len(frame), width), np.int64)
        for i, v in enumerate(frame["_q"]):
            out[i, : len(v)] = v
        return out

    def run(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(asked):
            width = max(candidates["_q"].map(len).max(), asked["_q"].map(len).max())
            own = Shard(candidates["_id"].to_numpy(np.int64), matrix(candidates, width))
            for query_id, q in zip(asked["_id"], matrix(asked, width), strict=True):
                out += [(query_id, i, s) for i, s in own.best(query_id, q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, HIT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
