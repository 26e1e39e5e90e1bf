"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

import numpy as np
from linkspark.llm import periodic, workload


def brute(words, least=12):
    """All runs: for every period, maximal stretches of places that equal the place a period later."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts(rng, count):
    for _ in range(count):
        n, kind = rng.choice([0, 1, 5, 11, 12, 13, 24, 40, 90, 300]), rng.random()
        words = [rng.choice("ab" if kind < 0.3 else "abcdefgh") for _ in range(n)]
        if kind > 0.5 and n > 12:
            a, p = rng.randrange(n), rng.randint(1, n // 2)
            words = words[:a] + [words[a + (i % p)] if a + (i % p) < n else "z" for i in range(n - a)]
        if kind > 0.9:
            words = ["a"] * n
        yield words


def test_runs_equal_all_periods():
    rng = random.Random(3)
    batch = list(texts(rng, 400))
    numbered = [np.array([ord(w) for w in t], np.int64) for t in batch]
    for at in (slice(0, 200), slice(200, 201), slice(201, 400)):
        for got, words in zip(periodic.maximal_runs(numbered[at]), batch[at], strict=True):
            assert [tuple(r) for r in got.tolist()] == brute(words)


def test_many_runs_and_small_chunks(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    monkeypatch.setattr(periodic, "GATHERED", 10)
    words = ("a b " * 30 + "c " * 40 + "a a b " * 50 + "x y z " * 5 + "a b " * 30 + "c " * 40).split()
    got = periodic.maximal_runs([np.array([ord(w) for w in words], np.int64)])[0]
    assert [tuple(r) for r in got.tolist()] == brute(words)


def test_extensions():
    rng = np.random.default_rng(5)
    word = np.concatenate([np.tile(rng.integers(0, 3, 17), 40), [-2], rng.integers(0, 2, 500), [-3]])
    text = np.repeat([0, 1], [681, 501])
    lce = periodic.Extensions(word, text)
    i = rng.integers(0, 1182, 4000)
    j = rng.integers(0, 1182, 4000)
    i, j = np.minimum(i, j), np.maximum(i, j)
    ok = (i < j) & (text[i] == text[j])
    for a, b, n in zip(i[ok], j[ok], lce(i[ok], j[ok]), strict=True):
        k = 0
        while word[a + k] == word[b + k]:
            k += 1
        assert n == k


def expected(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    words = [w for w in (text or "").encode().split()]
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_against_plain_version(spark):
    rows = {r.doc_id: r for r in workload.QUERIES["op12_difference_cover_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    checked = 0
    for d in docs:
        if len(d.text) < 4000 or zlib.crc32(str(d.doc_id).encode()) % 10 == 0 and len(d.text) < 20000:
            assert tuple(rows[d.doc_id])[1:] == expected(d.doc_id, d.text)
            checked += 1
    assert checked > 100


def test_odd_rows(spark):
    long = "w " * 300_000 + "end"
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b " * 10), (5, "a b " * 10), (5, "a b " * 10), (6, long), (7, "é é " * 12), (8, "a\x0bb\x0c" * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS start")
    found = periodic.find(docs, ["doc_id"]).collect()
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    twenty = [(0, 20, 2)]
    assert sorted(got, key=str) == sorted(
        [
            (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 20, twenty, "a b"), (5, 20, twenty, "a b"), (5, 20, twenty, "a b"),
            (6, 300_001, [(0, 300_000, 1)], "w end"), (7, 12, [(0, 12, 1)], "é é"), (8, 12, [(0, 12, 2)], "a b"),
        ],
        key=str,
    )
    assert periodic.digests(periodic.find(docs.limit(0), ["doc_id"], change=periodic.planted)).count() == 0
