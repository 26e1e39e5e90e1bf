"""Approximate nearest neighbours by counting collisions in windows around the query.

Every vector is projected on the directions of a few random rotations, and each projection is kept as a sorted array.
A query opens a window around its own projection in each array; a vector collides if it lies inside. Windows
grow by a factor (virtual rehashing, nothing is hashed again) until enough vectors collide in so many arrays
that they exceed the threshold; all of these are verified by their exact inner product. Vectors are extended
by one part so that all have the largest norm; then the largest inner product is the smallest distance.

Vectors are dealt over shards and queries over blocks; every pair of them is a task of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 8192, 4096
#: Random rotations, each with as many projections as the vectors have parts, and one.
ROTATIONS = 2
#: Share of the arrays in which a vector has to collide.
THRESHOLD = 0.85
#: Windows grow until this share of a shard's vectors is verified, and this many at least.
VERIFIED, LEAST = 0.12, 400
GROWTH = 1.1
#: Vectors of a shard that tell with which window its queries begin.
TRIED = 16


def projections(parts: int) -> np.ndarray:
    """Columns of random rotations, scaled so that a projection spreads like a part of the vector itself."""
    random = np.random.default_rng(20240)
    turns = [np.linalg.qr(random.normal(size=(parts, parts)))[0] for _ in range(ROTATIONS)]
    return np.hstack(turns) * np.sqrt(parts)


class Index:
    """Sorted projections of the vectors of one shard."""

    def __init__(self, vectors: np.ndarray, norm: float):
        self.vectors, self.norm = vectors, norm
        self.base = projections(vectors.shape[1] + 1)
        rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
        placed = vectors @ self.base[:-1] + rest[:, None] * self.base[-1]
        self.order = np.ascontiguousarray(np.argsort(placed, axis=0).T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.sort(placed, axis=0).T)
        self.width = self.usual_width()
        tried = vectors[:: max(1, len(vectors) // TRIED)][:TRIED]
        # the least that any of them needs: a smaller window is nearly always counted in vain
        self.width = min(self.window(v)[0] for v in tried)

    def usual_width(self) -> float:
        """Half window at which the projections of two vectors collide somewhat less often than ``THRESHOLD``."""
        return 1.2 * np.sqrt(2) * float(self.sorted.std(axis=1).mean()) or self.norm

    def misses(self, place: np.ndarray, half: float) -> np.ndarray:
        """In how many arrays each vector lies outside the window."""
        out = []
        for values, order, at in zip(self.sorted, self.order, place, strict=True):
            low, high = np.searchsorted(values, (at - half, at + half))
            out += [order[:low], order[high:]]
        return np.bincount(np.concatenate(out), minlength=len(self.vectors))

    def window(self, query: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the window at which enough vectors collide, and the places of these."""
        n, arrays = len(self.vectors), len(self.sorted)
        wanted = min(n, max(LEAST, int(VERIFIED * n)))
        place = (query * (self.norm / np.sqrt((query * query).sum()))) @ self.base[:-1]
        half = self.width
        while True:
            found = np.flatnonzero(self.misses(place, half) <= (1 - THRESHOLD) * arrays)
            if len(found) >= wanted:
                return half, found
            half *= GROWTH

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and inner products of the verified vectors."""
        _, found = self.window(query)
        return found, (self.vectors[found] * query).sum(axis=1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of vectors that are complete, finite and not zero; equal rows once."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(finite & F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` largest inner products found for every query.

    Queries are the vectors whose id is divisible by ``every``, candidates all vectors of the same length with another id.
    Vectors null, zero or with null or non-finite parts take no part. Equal scores are ranked by id.
    """
    rows = usable(vectors, vec_id, embedding)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, queries, longest = rows.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.sqrt(F.max(square))
    ).first()
    shards, blocks, norm = max(1, -(-n // SHARD)), max(1, -(-queries // BLOCK)), longest or 1.0

    dealt = rows.withColumns({"parts": F.size("v"), "spot": F.xxhash64("vec_id")})
    index = dealt.withColumn("shard", F.pmod("spot", F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = dealt.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("spot"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        queries, vectors, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(index) and len(asked):
            ids = index["vec_id"].to_numpy()
            shard = Index(np.stack(index["v"].to_numpy()), norm)
            for query, v in zip(asked["vec_id"], asked["v"], strict=True):
                found, score = shard.search(v)
                other = ids[found] != query
                found, score = ids[found[other]], score[other]
                best = np.lexsort((found, -score))[:k]
                queries.append(np.full(len(best), query))
                vectors.append(found[best])
                scores.append(score[best])
        return pd.DataFrame({"query_id": np.concatenate(queries), "vec_id": np.concatenate(vectors), "score": np.concatenate(scores)})

    key = ["parts", "shard", "block"]
    found = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
