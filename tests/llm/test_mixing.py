"""Mixing: targets by plain sharing, taken words near them, copies within bounds."""

import pytest
from pyspark.sql import functions as F

from linkspark.llm import mixing

DOCS = "/root/testdata/sf0.01/documents.parquet"


def shared_out(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets, by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def check(rows, near):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    want = shared_out(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= near
    assert all(r.source_size == sizes[r.source] for r in rows)


def test_whole_table(spark):
    docs = spark.read.parquet(DOCS)
    first = mixing.mix(docs, ["doc_id", "source"]).collect()
    check(first, 100)
    again = mixing.mix(docs.repartition(5), ["doc_id", "source"]).collect()
    assert {(r.doc_id, r.taken) for r in first} == {(r.doc_id, r.taken) for r in again}


def test_odd_rows_and_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_DOCS", 20)
    rows = [(i, "w " * (1 + i % 3), "hot") for i in range(200)] + [(i, "w " * 500, "big") for i in range(200, 204)]
    rows += [(300, None, "hot"), (301, "", None), (302, "one two", None), (302, "one two", None), (None, "x", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("n", F.lit(0))
    got = mixing.mix(docs.drop("size", "n"), ["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    check(got, 500)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = {}
    for r in out.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(v for k, v in copies.items() if k != 302) <= 2 and copies.get(302, 0) <= 4
    assert mixing.mix(docs.drop("size").limit(0), ["doc_id"]).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
