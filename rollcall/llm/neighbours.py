"""Nearest neighbours by inner product, with collision-counting hashing.

Vectors are lifted to the unit sphere so that the largest inner product is the smallest
distance. Each random projection keeps one sorted array of a block's vectors. A query's
window on each array is centred on its own projection; a vector that lies in the
window on enough arrays is a candidate, and all candidates are verified on the original vectors. Virtual rehashing
widens the windows together, by WIDEN at a time, until the candidates make up SHARE of the
block. Queries and vectors meet block by block; every block gives its best, the best of these are the answer.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without an id; vectors only meet vectors of the same length. A row is no neighbour of rows with its
own id. Repeated rows count as often as they come, as candidates and as queries once. Ties go to the smaller id. With fewer
candidates than asked for, all are returned. Other columns play no part.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

PROJECTIONS = 96
WIDTH = 1.1  # half a window at first, in standard deviations of a projection
COLLIDE = 0.6  # share of arrays on which a candidate has to be in the window
WIDEN = 1.25
SHARE = 0.25  # of a block's vectors that have to be candidates before the search ends
SEED = 7
BLOCK_ROWS, QUERY_ROWS = 8192, 4096

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Block:
    """The sorted arrays of one block of vectors."""

    def __init__(self, vectors: np.ndarray, largest: float):
        self.vectors, self.n = vectors, len(vectors)
        scaled = vectors / largest
        lifted = np.column_stack((scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))))
        self.axes = np.random.default_rng(SEED).normal(size=(lifted.shape[1], PROJECTIONS))
        seen = (lifted @ self.axes).T
        order = np.argsort(seen, axis=1)
        self.sorted = np.take_along_axis(seen, order, axis=1)
        # Where each vector stands on each array: being in a window is then being in a range of places.
        self.place = np.empty(seen.shape, dtype=np.uint16 if self.n <= 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(self.n, dtype=self.place.dtype), seen.shape), axis=1)

    def candidates(self, query: np.ndarray, least: int) -> np.ndarray:
        """The vectors that collide often enough, after widening the windows until there are at least so many."""
        centre = np.append(query / np.linalg.norm(query), 0.0) @ self.axes
        half = WIDTH
        while True:
            low = np.array([a.searchsorted(c - half, "left") for a, c in zip(self.sorted, centre)])
            high = np.array([a.searchsorted(c + half, "right") for a, c in zip(self.sorted, centre)])
            kind = self.place.dtype
            inside = (self.place - low.astype(kind)[:, None]) < (high - low).astype(np.uint32)[:, None].astype(kind if self.n < np.iinfo(kind).max else np.uint32)
            hits = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if PROJECTIONS < 256 else np.uint32)
            found = np.flatnonzero(hits >= COLLIDE * PROJECTIONS)
            if len(found) >= least or (low == 0).all() and (high == self.n).all():
                return found
            half *= WIDEN

    def best(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the block's best candidates, without the query's own id."""
        found = self.candidates(query, min(self.n, k + 1 + int(SHARE * self.n)))
        found = found[ids[found] != own]
        # Row by row in the same order, so that equal vectors get equal scores.
        score = (self.vectors[found] * query).sum(axis=1)
        if len(found) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[score >= edge], score[score >= edge]
        order = np.lexsort((ids[found], -score))[:k]
        return ids[found][order], score[order]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, size): rows with an id and a vector of finite numbers that are not all zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull()).where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long"), v.alias("v"), F.size("embedding").alias("size")
    )


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``queries`` (vec_id, embedding)."""
    data, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = data.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest"))
    counted = {r["size"]: (r["n"], r["largest"]) for r in sizes.collect()}  # one row per length of vectors
    n_asked = asked.count()
    if not counted or not n_asked:
        return data.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    parts = max(1, -(-max(n for n, _ in counted.values()) // BLOCK_ROWS))
    turns = max(1, -(-n_asked // QUERY_ROWS))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = data.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")).withColumn("turn", every(turns))
    right = asked.withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(turns)).cast("int")).withColumn("part", every(parts))

    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            block = block.sort_values("vec_id")
            ids = block["vec_id"].to_numpy()
            index = Block(np.stack(block["v"].tolist()), counted[int(block["size"].iloc[0])][1])
            for own, v in zip(asked["vec_id"], asked["v"]):
                near, score = index.best(np.asarray(v), ids, own, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": near, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["size", "part", "turn"]
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    # A query has at most k rows from each block here.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
