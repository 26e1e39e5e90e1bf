"""Attention over passages: gradients by differences, held-out quality, odd texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkspark.llm import passages
from linkspark.llm.tables import held_out, text_slices

SF = "/root/testdata/sf0.1"


def rows_of(texts):
    (_, _, data, offsets), *_ = text_slices(pa.array(texts))
    return passages.features(data, offsets)


def test_features_do_not_depend_on_neighbours():
    texts = ["The cat sat", "", "x " * 200, "The cat sat", None, "a\nb\nc"]
    x, first = rows_of(texts)
    assert list(np.diff(first)) == [1, 1, 4, 1, 1, 1]
    for i, t in enumerate(texts):
        alone, _ = rows_of([t])
        assert np.allclose(alone, x[first[i] : first[i + 1]])


def test_gradients():
    random = np.random.default_rng(0)
    x, first = random.normal(size=(7, 6)), np.array([0, 3, 4, 7])
    label = np.array([1.0, 0.0, 1.0])
    shape = {"encode": (6, 4), "shift": (4,), "value": (4, 3), "gate": (4, 3), "attend": (3,), "out": (4,)}
    weights = {k: random.normal(size=s) for k, s in shape.items()} | {"bias": np.array(0.1)}
    model = passages.Model(np.zeros(6), np.ones(6), weights)

    def loss():
        p = model.score(x, first)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for name, found in passages.gradients(model, x, first, label).items():
        w = weights[name]
        for at in np.ndindex(w.shape):
            old, values = w[at].copy(), []
            for step in (1e-5, -1e-5):
                w[at] = old + step
                values.append(loss())
            w[at] = old
            assert abs((values[0] - values[1]) / 2e-5 - np.asarray(found)[at]) < 1e-6, name


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = passages.train(docs, labels)
    some = labels.where(held_out()).join(docs, "doc_id")
    found = passages.scored(some, model, ["doc_id", "quality"]).collect()
    good = np.array([r.score for r in found if r.quality == 1])
    bad = np.array([r.score for r in found if r.quality == 0])
    assert np.mean(good[:, None] > bad[None, :]) > 0.98
    assert np.mean(np.concatenate([good >= 0.3, bad < 0.3])) > 0.95


def test_odd_texts_and_nothing_learned(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 100_000), (3, "w " * 100_000), (None, "x")], "doc_id long, text string")
    docs = docs.withColumn("_label", F.lit(1)).withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = passages.train(docs, none)
    assert [r.score for r in passages.scored(docs, model, ["doc_id"]).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    found = passages.scored(docs, passages.train(docs, labels), ["doc_id"]).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert passages.scored(docs.limit(0), model, ["doc_id"]).count() == 0
