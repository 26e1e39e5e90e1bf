"""What the lists of operator 1 and of near copies take."""

import numpy as np
from linkspark.llm import graphs, jaccard

from test_intermediate import tables_left


def test_tables_of_operator_1_are_gone(spark, monkeypatch):
    made, left = tables_left(spark, monkeypatch, jaccard.similar, jaccard, graphs)
    assert made > 8 and left <= 4


def test_lists_with_the_same_members_are_compared_once(spark):
    # two sets in 30 lists, a third one in two of these as well; a list of one component is left out
    rows = [(100 + k, node, k + node, node) for k in range(30) for node in (1, 2)] + [(100 + k, 3, k + 5, 3) for k in (7, 8)]
    rows += [(500, 1, 0, 1), (500, 4, 0, 1)]
    placed = spark.createDataFrame(rows, "key long, node long, pos long, comp long")
    assert sorted(r.key for r in jaccard.told_apart(placed).collect()) == [100, 107]


def test_parities_tell_sets_without_common_shingles_apart():
    random = np.random.default_rng(7)
    for n in (300, 1030, 3700):
        a, b = (np.unique(random.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        d = jaccard.least_difference(jaccard.parity(a), jaccard.parity(b))
        assert 100 * (2 * n - d) < 80 * (2 * n + d)
