"""From raw documents to training tokens: five stages, each over all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm import bpe, credentials, jaccard, language, mixing
from linkspark.llm.tables import plain_names, stored, table
from linkspark.llm.workload import tokenizer_path


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share this percentage of their shingles of so many words; the query of operator 1 has its own figures.
COPY_WIDTH, COPY_PERCENT = 5, 80


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; texts without letters and with narrow margins go.

    Null and empty texts have no letters. Every row is judged by its own whole text, so repeated rows fare alike; an empty table
    keeps nothing, and columns of any name are kept.
    """
    plain = plain_names(docs, COLUMNS)
    found = language.identify(plain, language.train(docs), plain.columns).where("accepted")
    return found.select(*plain.columns).toDF(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Rows without id, and those of an id that several rows have, are told apart by id and text: of equal ones one stays, the
    first by its other columns, and of similar ones any row with an id of its own goes before them. Texts without words
    are similar to none. Very long texts are compared whole; columns of any name are kept.
    """
    plain = plain_names(docs, COLUMNS)
    others = [c for c in plain.columns if c not in ("doc_id", "text")]
    repeated = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_again"))
    # usually a tiny table, and Spark knows that once it is stored, so the texts are not shuffled for it
    known = plain.join(stored(repeated), F.col("doc_id") == F.col("_again"), "left")
    unclear = F.col("doc_id").isNull() | F.col("_again").isNotNull()
    # beyond all ids that are in use, so a row with an id of its own comes first
    own = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), F.lit(1 << 61))
    keyed = known.withColumn("_own", F.when(unclear, own).otherwise(F.col("doc_id").cast("long"))).withColumn("_unclear", unclear)
    found = jaccard.similar(keyed.select(F.col("_own").alias("doc_id"), "text"), width=COPY_WIDTH, percent=COPY_PERCENT)
    heads = found.where("doc_id = component_id").select(F.col("doc_id").alias("_own")).distinct()
    clear = keyed.where("NOT _unclear").join(heads, "_own", "left_semi")
    first = Window.partitionBy("_own").orderBy(*others)
    rest = keyed.where("_unclear").join(heads, "_own", "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return clear.select(*plain.columns).union(rest.select(*plain.columns)).toDF(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; null texts stay null, repeated rows are changed alike.

    Very long texts are searched whole; the number of characters is counted anew; columns of any name are kept.
    """
    plain = plain_names(docs, COLUMNS)
    changed = credentials.redacted(plain).withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*plain.columns).toDF(*docs.columns)


def balanced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Null sources are a source; texts without words have no size and are not taken; equal rows are taken one by one; an empty
    table gives an empty mix.
    """
    return mixing.mixed(plain_names(docs, COLUMNS)).toDF(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document of the mix, as digests; null and empty texts have none, very long texts are encoded whole."""
    return bpe.digests(docs, tokenizer_path(), ["doc_id"])


STAGES = [
    ("language", identified),
    ("near copies", deduplicated),
    ("secrets", without_secrets),
    ("mixing", balanced),
    ("tokens", encoded),
]
#: The first stage has no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
