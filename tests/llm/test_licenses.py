"""Licence notices: SQL over whole tables, bounds, odd texts."""

import compare
from pyspark.sql import functions as F

from linkspark.llm import licenses

SF = "/root/testdata/sf0.01"


def test_equals_sql(spark):
    got = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id"]).toPandas()
    assert compare.difference(got, compare.connect(SF).execute(licenses.oracle()).df()) is None
    assert (got.n_matches > 0).sum() > 10


def test_bounds_are_exact():
    for n in range(1, 60):
        low, high = licenses.bounds(n)
        fits = [k for k in range(1, 300) if 2 * min(k, n) / (k + n) >= licenses.LEAST]
        assert (low, high) == (fits[0], fits[-1])


def test_every_match_has_a_key_word():
    for _, text in licenses.TEMPLATES:
        bigrams = licenses.bigrams_of(licenses.words_of(text))
        keys = licenses.key_words(bigrams)
        without = {b for b in bigrams if not set(b.split()) & set(keys)}
        # the most that a text without a key word can reach: all other bigrams and nothing else
        assert 2 * len(without) / (len(bigrams) + max(1, len(without))) < licenses.LEAST


def test_odd_texts(spark):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, notice), (3, notice), (4, " ".join(f"w{i}" for i in range(40_000)) + "\n" + notice), (None, notice), (5, "license"), (6, "the MIT License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = [(r.doc_id, r.n_matches, r.license) for r in licenses.scan(docs, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, None), (2, 0, None), (3, 1, "MIT"), (3, 1, "MIT"), (4, 1, "MIT"), (None, 1, "MIT"), (5, 0, None), (6, 0, None)], key=str
    )
    assert licenses.scan(docs.limit(0), ["doc_id"]).count() == 0


def test_each_text_is_changed_once(spark):
    df = spark.createDataFrame([("Released under the MIT License.",)], "text string")
    plan = df.select(licenses.matches(F.col("text")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^A-Za-z0-9\\n]+") + plan.count("[^A-Za-z0-9\n]+") == 1
