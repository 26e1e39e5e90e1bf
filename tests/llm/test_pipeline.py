"""The stages against plain versions, on their own inputs."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
from linkspark.llm import mixing
from linkspark.llm.tables import stored
from tokenizers import Tokenizer

from test_near_copies import kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS score", "'x' AS _row", "'y' AS _key")
    named, deduplicated, clean, mix, tokens = (f for _, f in corpus_pipeline.STAGES)
    one = stored(named(spark, docs, SF))
    assert one.columns == docs.columns and 0.95 * docs.count() < one.count() <= docs.count()
    two = stored(deduplicated(spark, one, SF))
    want = kept([tuple(r) for r in one.select("doc_id", "text").collect()])
    assert {r.doc_id for r in two.select("doc_id").collect()} == want and two.count() == len(want)
    three = stored(clean(spark, two, SF))
    before, after = (dict(t.select("doc_id", "text").collect()) for t in (two, three))
    assert before.keys() == after.keys() and three.columns == docs.columns
    secret = re.compile(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}")
    assert not any(secret.search(t) for t in after.values())
    assert all(before[i] == after[i] or "[secret]" in after[i] for i in before)
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = stored(mix(spark, three, SF))
    assert four.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(three, ["doc_id"]).collect()}
    assert sum(copies.values()) * 0.8 < four.count() < sum(copies.values()) * 1.2
    assert {r[0] for r in four.groupBy("doc_id").count().select("count").distinct().collect()} <= {1, 2}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in four.select("doc_id", "text").distinct().collect()}
    five = tokens(spark, four, SF).collect()
    assert len(five) == four.count()
    for r in five:
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest()


def test_empty_table_and_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()


def test_same_ids_and_no_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(1, text["a"]), (1, text["b"]), (1, text["b"]), (2, text["c"]), (None, text["c"]), (None, text["d"]), (None, text["d"]), (3, text["d"] + " end")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((str(r.doc_id), r.text[0]) for r in corpus_pipeline.deduplicated(spark, docs, SF).collect())
    assert kept == [("1", "a"), ("1", "b"), ("2", "c"), ("3", "d")]
