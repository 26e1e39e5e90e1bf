"""What intermediate tables and filters take: no table outlives the last query that reads it, no filter fills up."""

import os

import numpy as np
from linkspark.llm import suffix
from linkspark.llm.tables import dropped, stored


def folder_of(df):
    return os.path.dirname(df.inputFiles()[0]).removeprefix("file://").removeprefix("file:")


def texts(n):
    random = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(random.choice(words, 60))
    rows = [" ".join(random.choice(words, 80)) for _ in range(n)]
    return [f"{t} {passage}" if i % 3 else f"{t} end" * (1 + i % 2) for i, t in enumerate(rows)] + rows[:5]


def tables_left(spark, monkeypatch, fn, *modules):
    """Intermediate tables that ``fn`` made, and those that are still there when its result can be read."""
    made = []

    def watched(df):
        out = stored(df)
        made.append(folder_of(out))
        return out

    for module in modules:
        monkeypatch.setattr(module, "stored", watched)
    rows = [(i, t) for i, t in enumerate(texts(40))]
    found = fn(spark.createDataFrame(rows, "doc_id long, text string"))
    left = sum(os.path.exists(f) for f in made)
    assert found.count() == len(rows)
    return len(made), left


def test_only_stored_tables_are_dropped(spark, folder):
    spark.range(5).write.parquet(f"{folder}/table")
    given, own = spark.read.parquet(f"{folder}/table"), stored(spark.range(5))
    where = folder_of(own)
    dropped(given, own)
    assert given.count() == 5 and not os.path.exists(where)


def test_filters_grow_with_their_values(spark, monkeypatch):
    monkeypatch.setattr(suffix, "FILTER_BITS", 1 << 16)
    random = np.random.default_rng(6)
    values, others = random.integers(-(1 << 63), 1 << 63, (2, 60_000))
    bits = suffix.fixed_filter(spark.createDataFrame([(v,) for v in values.tolist()], "v long"), "v")
    assert suffix.in_filter(bits, values).all()
    assert suffix.in_filter(bits, others).mean() < 0.06


def test_tables_of_operator_4_are_gone(spark, monkeypatch):
    made, left = tables_left(spark, monkeypatch, suffix.removed, suffix)
    assert made > 8 and left <= 4
