"""Exact products and hard negatives against plain versions."""

import random

import duckdb
import numpy as np
import pytest
from linkspark.llm import strassen, workload
from pyspark.sql import functions as F


def test_product_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (33, 64, 100), (70, 65, 131), (5, 200, 3), (128, 128, 128), (40, 0, 3)]:
        a, b = rng.integers(-(1 << 28), 1 << 28, (m, k)), rng.integers(-100, 100, (k, n))
        assert (strassen.product(a, b) == a @ b).all()


def test_products_beyond_64_bits_are_cut():
    a = np.full((2, 40), strassen.MOST)
    assert strassen.product(a, a.T.copy()).tolist() == [[(1 << 63) - 1] * 2] * 2
    assert strassen.product(a, np.ones((40, 1), np.int64)).tolist() == [[40 * strassen.MOST]] * 2


def test_heaps_with_ties_and_large_scores():
    rng = np.random.default_rng(2)
    for shift in (0, 60):
        scores = rng.integers(-3, 4, (20, 50)) << shift
        ids, allowed = rng.permutation(50) * 7, rng.random((20, 50)) < 0.5
        rows, columns = strassen.heap(scores, ids, allowed, 6)
        for r in range(20):
            want = sorted(np.flatnonzero(allowed[r]), key=lambda c: (-int(scores[r, c]), ids[c]))[:6]
            assert sorted(columns[rows == r]) == sorted(want)


@pytest.mark.parametrize("cells", [1 << 18, 3000])
def test_query_equals_sql(spark, monkeypatch, cells):
    monkeypatch.setattr(strassen, "CELLS", cells)
    sf = "/root/testdata/sf0.01"
    got = workload.QUERIES["op13_strassen_negatives"](spark, sf)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({strassen.oracle()})").fetchall()
    assert len(want) > 100 and sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want)


def plain(rows, positives, negatives, low, high):
    ok = [r for r in rows if None not in r[:3] and all(x is not None and np.isfinite(x) for x in r[1])]
    ints = [(i, [max(-strassen.MOST, min(strassen.MOST, int(np.floor(x * 256)))) for x in v], n) for i, v, n in ok]
    out = []
    for i in sorted({r[0] for r in ints if r[0] % 3 == 0}):
        _, v, n = min(((r[0], ok[k][1], r[2], r[1]) for k, r in enumerate(ints) if r[0] == i), key=lambda r: (r[2], r[1]))[0:3]
        v = next(r[1] for k, r in enumerate(ints) if r[0] == i and r[2] == n and ok[k][1] == v)
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=False))
        near = sorted((-score(w), j) for j, w, m in ints if m == n and j != i)[:positives]
        for s, j in near:
            hard = sorted((-score(w), k) for k, w, m in ints if m != n and -low * s <= 100 * score(w) <= -high * s)[:negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(hard, 1)]
    return sorted(out)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(4)
    rows = [(rng.randrange(60), [rng.choice([0.5, 1.0, -0.25, 2.0, 0.001]) for _ in range(rng.choice([2, 3]))], rng.randrange(3)) for _ in range(120)]
    rows += [(3, None, 1), (6, [nan, 1.0], 1), (9, [inf, 1.0], 1), (12, [None, 1.0], 0), (15, [1.0], None), (None, [1.0], 1), (18, [], 1), (21, [0.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS score", "2 AS anchor", "3 AS slot")
    got = strassen.mine(table, F.col("vec_id") % 3 == 0, 4, 6)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 4, 6, 30, 90)
    assert strassen.mine(table.limit(0), F.col("vec_id") % 3 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0], 1), (1, [1e300, 0.0], 1), (2, [1e292, 1.0], 2), (3, [1.0, 1.0], 2)], table.select("vec_id", "embedding", "label").schema)
    assert [r.negative_id for r in strassen.mine(huge, F.col("vec_id") == 0).collect()] == []
