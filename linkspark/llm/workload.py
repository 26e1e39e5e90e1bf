"""Registered queries of the corpus operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import bpe, chat, credentials, jaccard, language, licenses, mixing, neighbours, outliers, passages, periodic, strassen, suffix
from linkspark.llm.tables import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_bpe_prefix_tokens(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])


@query
def op6_compression_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


@query
def op2_linked_secrets(spark, sf_dir):
    return credentials.report(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op8_license_dice(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])


ORACLES["op8_license_dice"] = licenses.oracle()


@query
def op10_entropy_balance(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op3_robust_outliers(spark, sf_dir):
    found = outliers.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@query
def op9_attention_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = passages.train(docs, table(spark, sf_dir, "labels"))
    found = passages.scored(docs, model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_collision_counting(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op1_ngram_jaccard(spark, sf_dir):
    return jaccard.similar(table(spark, sf_dir, "documents"))


@query
def op4_suffix_array_dedup(spark, sf_dir):
    return suffix.removed(table(spark, sf_dir, "documents"))


@query
def op12_difference_cover_runs(spark, sf_dir):
    return periodic.digests(periodic.find(table(spark, sf_dir, "documents"), ["doc_id"], change=periodic.planted))


@query
def op13_strassen_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return strassen.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLES["op13_strassen_negatives"] = strassen.oracle()


@query
def op11_budgeted_windows(spark, sf_dir):
    return chat.read_back(chat.windows(chat.with_control_strings(table(spark, sf_dir, "conversations"))))


ORACLES["op11_budgeted_windows"] = chat.oracle()
