"""Hashes of spans: texts that collide for every base modulo a power of two must not."""

import random

import numpy as np
from linkspark.llm import jaccard, outliers, suffix, words


def alternating(n, marks, flip):
    """Bytes that are the same in both texts, and every tenth by the parity of ones in its number, the other way round in the
    other text: sums over such a sequence cancel modulo powers of two."""
    rng = random.Random(8)
    return "".join("".join(rng.choice("abcdefgh") for _ in range(9)) + marks[(i.bit_count() + flip) % 2] for i in range(n))


ONE, TWO = (alternating(1024, "pq", f) for f in (0, 1))


def test_alternating_texts_share_nothing(spark):
    one, two = ({t[k : k + 50] for k in range(len(t) - 49)} for t in (ONE, TWO))
    assert not one & two
    removed = suffix.removed(spark.createDataFrame([(1, ONE), (2, TWO)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in removed] == [0, 0]


def test_spaced_texts_are_not_linked(spark):
    # single words of 10,240 bytes, then texts whose words differ in the same order
    rows = [(1, ONE), (2, TWO), (3, " ".join(alternating(1024, ("p ", "q "), 0).split())), (4, " ".join(alternating(1024, ("p ", "q "), 1).split()))]
    linked = {r.doc_id: r.component_id for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert linked[1] == 1 and linked[2] == 2


def test_long_lines_are_not_equal():
    data = f"{ONE}\n{TWO}\n".encode()
    counts = outliers.count_slice(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert counts[outliers.COUNTS.index("n_dup_lines")][0] == 0


def test_span_and_short_hashes_tell_equal_spans_only():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(4000)), np.uint8)
    starts = np.array([rng.randrange(3900) for _ in range(3000)])
    sizes = np.array([rng.randrange(90) for _ in range(3000)])
    spans = [data[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)]
    for found in (words.span_hashes(words.running(data), starts, starts + sizes), words.short_hashes(data, starts, sizes, 90)):
        assert len(set(found.tolist())) == len(set(spans)) == len(set(zip(spans, found.tolist(), strict=True)))
    assert not set(words.short_hashes(data, starts, sizes, 90, 1).tolist()) & set(words.short_hashes(data, starts, sizes, 90, 2).tolist())


def test_empty_data():
    none = np.zeros(0, np.int64)
    assert len(words.span_hashes(words.running(np.zeros(0, np.uint8)), none, none)) == 0
