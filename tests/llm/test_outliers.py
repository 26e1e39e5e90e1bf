"""Quality rules: counts against a plain version, and outliers among usual texts."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from linkspark.llm import outliers

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(found), sum(map(len, found)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_counts_and_verdicts(spark):
    odd = [
        (-1, None), (-2, ""), (-3, "\n\n"), (-4, "a\nb\na\n\na"), (-5, " lead\x0b\x0cword"), (-6, "ä ö ü | # ü"), (-7, "x " * 60_000),
        (-8, "end\n"), (-9, "a b c d e a b c d e"), (-9, "a b c d e a b c d e"), (None, "  x"),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS STRING)", "'s'"))
    got = outliers.judge(docs.withColumn("group", F.lit(1)).withColumn("kept", F.lit("x")), ["doc_id"]).collect()
    text = dict(docs.select("doc_id", "text").collect())
    assert len(got) == docs.count()
    for r in got:
        want = counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    label = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    good = [r.kept for r in got if label.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in got if label.get(r.doc_id) == 0 and not r.base_failed]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.5


def test_estimate_ignores_a_quarter_of_outliers(spark):
    random = np.random.default_rng(1)
    usual = random.normal(size=(800, 5)) * [0.2, 0.3, 0.3, 0.3, 0.2] + [1, 2, 3, 4, 5]
    far = random.normal(size=(160, 5)) * 0.1 + 30
    rows = [("g", *map(float, x)) for x in np.vstack([usual, far])]
    frame = spark.createDataFrame(rows, "group string, " + ", ".join(f"{c} double" for c in outliers.SHARES))
    mean = outliers.fit(frame).first()["mean"]
    assert np.abs(np.array(mean) - [1, 2, 3, 4, 5]).max() < 0.1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert outliers.judge(docs, ["doc_id"]).count() == 0
