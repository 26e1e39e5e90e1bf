"""Language identification: held-out accuracy and defined results for odd texts."""

from pyspark.sql import functions as F

from linkspark.llm import language
from linkspark.llm.tables import held_out

DE = "das alte haus und der kleine hof liegen zwischen den beiden hohen bergen"
EN = "the old house and the little yard are lying between those two high mountains"
DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    found = language.identify(docs, language.train(docs), ["doc_id", "lang"]).where(held_out())
    right, accepted, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("accepted").cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97 and accepted > 0.97


def test_training_leaves_held_out_rows_and_labels_alone(spark):
    docs = spark.read.parquet(DOCS).withColumn("lang", F.when(held_out(), "held").otherwise(F.col("lang")))
    assert "held" not in language.train(docs).content


def test_odd_texts_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "12 + 34 !"), (4, "wort " * 50_000), (5, DE), (5, DE), (None, EN)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    model = language.Classifier(language.dictionaries([("de", DE + " und wort"), ("en", EN + " and more")]))
    got = language.identify(docs, model, ["doc_id"]).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 7
    assert {(by_id[i].lang_pred, by_id[i].score, by_id[i].accepted) for i in (1, 2, 3)} == {("und", 0.0, False)}
    assert by_id[5].lang_pred == "de" and by_id[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    nothing = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.identify(docs.limit(0), model, ["doc_id"]).count() == 0


def test_ties_go_to_the_language_with_more_training_text():
    model = language.Classifier(language.dictionaries([("aa", "xyz"), ("bb", "xyz"), ("bb", "xyz")]))
    assert model.classify("q")[0] == "bb" and not model.classify("q")[2]
