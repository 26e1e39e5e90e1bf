"""Repeated byte strings against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm import suffix


def brute(rows):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first.setdefault(data[k : k + 50], i) < i:
                gone[k : k + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    pick = random.Random(9)
    text = lambda n: "".join(pick.choice("abcdé fgh\0") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 70, 200, 600)]
    rows = []
    for i in range(60):
        parts = [pick.choice([text(pick.randint(0, 90)), pick.choice(passages), pick.choice(passages)[: pick.randint(30, 80)]]) for _ in range(6)]
        rows.append((i * 2, "".join(parts)))
    rows += [(1001, "x" * 49), (1002, "x" * 49), (1003, "x" * 50), (1004, "x" * 5000), (1005, "xy" * 4000), (1006, "yx" * 3000), (1007, ""), (1008, None)]
    return rows + [(3, rows[10][1]), (1009, rows[10][1]), (1010, "x" * 50)]


@pytest.mark.parametrize("split", [5000, 2])
def test_equals_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(suffix, "SPLIT", split)
    monkeypatch.setattr(suffix, "SHARD", 50)
    monkeypatch.setattr(suffix, "RANGE", 300)
    rows = corpus()
    docs = spark.createDataFrame([*rows, (None, rows[10][1]), (0, rows[0][1])], "doc_id long, text string")
    docs = docs.withColumn("h", F.lit(1)).withColumn("bytes", F.lit("x"))
    got = suffix.removed(docs.repartition(4)).collect()
    want = brute(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        found = (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        if r.doc_id is None:
            assert found[1:3] == (0, 0)
        else:
            assert found == want[r.doc_id], r.doc_id


def test_kept_bytes_and_empty_table(spark):
    passage = "".join(chr(97 + i * 7 % 26) for i in range(60))
    docs = spark.createDataFrame([(1, passage), (2, "ab" + passage + "cd"), (3, passage), (4, "own")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in suffix.kept_bytes(docs).collect()} == {1: None, 2: bytearray(b"abcd"), 3: bytearray(b""), 4: None}
    assert suffix.removed(docs.limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    pick = np.random.default_rng(4)
    for data in (pick.integers(97, 99, 800).astype(np.uint8), np.tile(pick.integers(97, 123, 90), 8).astype(np.uint8), np.zeros(5, np.uint8)):
        order, _ = suffix.suffix_array(data)
        whole = data.tobytes() + b"\0" * 64
        keys = [whole[i : i + 64] for i in order]
        assert keys == sorted(keys)
        found = suffix.common_prefixes(data, order, np.array([0]), np.array([len(data)]))
        for place in range(1, len(data)):
            a, b = data[order[place - 1] :], data[order[place] :]
            n = min(len(a), len(b), 64)
            same = int(np.argmin(np.append(a[:n] == b[:n], False)))
            assert found[place] == same, place


def test_digests_of_whole_texts_are_stored_as_bytes(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.sha for r in suffix.summaries(docs).collect()}
    assert {k: bytes(v) for k, v in rows.items()} == {1: hashlib.sha256(b"a text").digest(), 2: hashlib.sha256(b"").digest()}
    got = {r.doc_id: r.kept_sha256 for r in suffix.removed(docs).collect()}
    assert got == {1: hashlib.sha256(b"a text").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("part", [1 << 19, 200])
def test_shared_anchors_travel_packed(spark, monkeypatch, part):
    monkeypatch.setattr(suffix, "PART", part)
    texts = [t or "" for _, t in corpus()]
    want, n = {}, 0
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        text, start, strings, h = suffix.anchors(data, np.array([0, len(data)]))
        _, s, block = suffix.blocks_of(text, start, strings, h, data)
        n += len(h)
        for x, y in zip(h.view(np.int64).tolist(), s[block, 0].tolist(), strict=True):
            want.setdefault(x, set()).add(y)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    n_bytes = sum(len(t.encode()) for t in texts)
    got = [r.h for r in suffix.shared_anchors(docs, n_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x, s in want.items() if len(s) > 1}
    parts = 7 if part == 200 else 1
    assert suffix.anchor_blocks(docs, parts).count() <= parts * (n // part + 1)
