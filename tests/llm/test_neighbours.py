"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from linkspark.llm import neighbours


def brute(ids, vectors, query, k=20):
    score = (vectors * vectors[query]).sum(axis=1)
    other = ids != ids[query]
    best = np.lexsort((ids[other], -score[other]))[:k]
    return list(zip(ids[other][best].tolist(), score[other][best].tolist(), strict=True))


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 700)
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    frame = table.toPandas()
    ids, vectors = frame.vec_id.to_numpy(), np.stack(frame.embedding).astype(float)
    got = {}
    for r in neighbours.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        found = sorted(got[ids[q]])
        assert [r for r, _, _ in found] == list(range(1, 21))
        recall.append(len({v for _, v, _ in found} & {v for v, _ in brute(ids, vectors, q)}) / 20)
    assert np.mean(recall) >= 0.9


def test_ties_odd_vectors_and_norms(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.5, 9.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0])]
    rows += [(8, [None, 1.0]), (None, [1.0, 1.0]), (2, [2.0, 0.0]), (9, [1.0, 2.0, 3.0]), (40, [0.0, 0.0]), (60, []), (80, None), (-20, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(table).orderBy("query_id", "rank").collect()]
    assert got == [
        (-20, 1, 3, -0.5), (-20, 2, 20, -1.0), (-20, 3, 1, -2.0), (-20, 4, 2, -2.0),
        (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 3, 0.5), (20, 4, -20, -1.0),
    ]
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_few_windows_are_counted_in_vain(monkeypatch):
    random = np.random.default_rng(7)
    vectors = random.normal(size=(4000, 64))
    counted, misses = [], neighbours.Index.misses
    monkeypatch.setattr(neighbours.Index, "misses", lambda self, place, half: counted.append(half) or misses(self, place, half))
    shard = neighbours.Index(vectors, float(np.sqrt((vectors * vectors).sum(axis=1).max())))
    counted.clear()
    for v in vectors[::40]:
        found, _ = shard.search(v)
        assert len(found) >= max(neighbours.LEAST, int(neighbours.VERIFIED * len(vectors)))
    assert len(counted) <= 150
