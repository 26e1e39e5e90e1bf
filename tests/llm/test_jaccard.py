"""Similar texts against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from linkspark.llm import jaccard
from linkspark.llm.graphs import components


def shingles(text, width=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in (text or "").translate(lower)).split(" ") if w]
    if 0 < len(found) < width:
        return {tuple(found)}
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus():
    pick = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        words = [pick.choice(vocabulary) for _ in range(pick.choice([8, 12, 25, 60, 90, 130, 200, 400]))]
        for _ in range(pick.choice([1, 3, 12])):
            copy = list(words)
            for _ in range(pick.randint(0, max(1, len(copy) // 50))):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(copy) + (" END" if base % 2 else "")))
    passage = " ".join(vocabulary[:40])
    rows += [(5000 + i, passage + " " + " ".join(pick.choice(vocabulary) for _ in range(30))) for i in range(30)]
    rows += [(6000 + i, " ".join(f"s{(i + k) % 140}" for k in range(130))) for i in range(12)]
    return rows + [(9000, "two words"), (9001, "Two\tWORDS"), (9002, ""), (9004, "É x y"), (9005, "é x y"), (9006, "z " * 40_000)]


def test_equals_all_pairs(spark):
    rows = corpus()
    more = [*rows, (rows[0]), (9100, None), (None, "two words"), (None, None), (None, "nobody has this text")]
    docs = spark.createDataFrame(more, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("key", F.lit(1))
    got = jaccard.similar(docs.repartition(6)).collect()
    want = brute(rows)
    assert len(got) == len(more)
    for r in got:
        if r.doc_id in want:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
    assert sorted((r.n_shingles, str(r.component_id)) for r in got if r.doc_id is None) == [(0, "None"), (1, "9000"), (2, "None")]
    assert jaccard.similar(docs.limit(0)).count() == 0


def test_bounds():
    random_ = np.random.default_rng(2)
    for n in (70, 300, 2000):
        a = np.unique(random_.integers(0, 1 << 63, n).astype(np.uint64))
        for drop in (0, 1, 5, n // 10):
            b = np.unique(np.concatenate([a[drop:], random_.integers(0, 1 << 63, drop).astype(np.uint64)]))
            assert jaccard.least_difference(jaccard.parity(a), jaccard.parity(b)) <= len(np.setxor1d(a, b))
    assert [jaccard.missing(n) for n in (1, 9, 10, 19, 20, 100)] == [0, 0, 1, 1, 2, 10]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (102, 100)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 104)}


def test_small_sets_meet_larger_ones(spark):
    nine = " ".join(f"a{i}" for i in range(11))
    rows = [(1, nine), (2, nine + " b"), (3, nine + " b c"), (4, " ".join(f"c{i}" for i in range(10))), (5, " ".join(f"c{i}" for i in range(11)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert got[2] == (10, 1)


def test_what_a_verification_stores_is_smaller_than_its_texts(spark, monkeypatch):
    import glob
    import os

    random = np.random.default_rng(5)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(random.choice(words, 3000)) for _ in range(20)]
    docs = spark.createDataFrame([(2 * i + k, t + " end" * k) for i, t in enumerate(texts) for k in (0, 1)], "doc_id long, text string").coalesce(2)
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(20)] + [(0, 2)], "a long, b long")
    tables, stored = [], jaccard.stored

    def watched(df):
        tables.append(stored(df))
        return tables[-1]

    monkeypatch.setattr(jaccard, "stored", watched)
    links = jaccard.verified(pairs, docs, 3, 90).collect()
    assert sorted((r.u, r.v) for r in links) == [(2 * i, 2 * i + 1) for i in range(20)]
    size = sum(os.path.getsize(f) for t in tables for part in t.inputFiles() for f in glob.glob(part.removeprefix("file:")))
    assert size < sum(len(t) for t in texts) * 2
