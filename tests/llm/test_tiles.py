"""How anchor and candidate blocks of operator 13 meet."""

import numpy as np
import pytest
from linkspark.llm import strassen
from pyspark.sql import functions as F


def test_anchor_copies_are_not_broadcast_and_follow_the_input(spark):
    rows = lambda n: spark.range(n).selectExpr("id AS first", "1L AS n", "cast(cast(id AS string) AS binary) AS ids")
    met = strassen.tiles(rows(5), rows(7), 4, 3)
    assert sorted((r.a_first, r.c_first) for r in met.collect()) == [(a, c) for a in range(5) for c in range(7)]
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    for n in (10_000, 600_000, 20_000_000):
        lanes, groups = strassen.grid(n // 4096 + 1, n, n // 100)
        assert lanes * (n // 100) <= n and groups <= 1 + n // 100 / (strassen.ANCHORS * strassen.GROUP)
    assert strassen.grid(0, 0, 0) == (1, 1)


@pytest.mark.parametrize("size", [1, 64])
def test_groups_of_anchors_change_nothing(spark, monkeypatch, size):
    random = np.random.default_rng(8)
    rows = [(i, random.normal(size=4).tolist(), int(random.integers(3))) for i in range(300)]
    monkeypatch.setattr(strassen, "ANCHORS", 10)
    monkeypatch.setattr(strassen, "CELLS", 100)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(tuple(r) for r in strassen.mine(table, F.col("vec_id") % 5 == 0, 2, 3).collect())
    monkeypatch.setattr(strassen, "GROUP", size)
    assert want and sorted(tuple(r) for r in strassen.mine(table, F.col("vec_id") % 5 == 0, 2, 3).collect()) == want
