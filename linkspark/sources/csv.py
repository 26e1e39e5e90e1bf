"""Observation files: charset, dialect, scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators import cleaning

DELIMITERS = [",", ";", "\t", "|"]

# --- fixed values: bytes that a single-byte charset does not define, as latin-1 characters ---
UNDEFINED_BYTES = {
    "windows-1255": "[\u0081\u008a\u008c-\u0090\u009a\u009c-\u009fÊÙ-ßûüÿ]",
    "ISO-8859-8": "[¡¿-Þûüÿ]",
    "windows-1252": "[\u0081\u008d\u008f\u0090\u009d]",
}
# bytes that read as Hebrew in windows-1255 / as Greek in ISO-8859-7
HEBREW_BYTES = "[À-ÉË-Øà-ú]"
GREEK_BYTES = "[´-¶¸-º¼¾-ÑÓ-þ]"
GREEK_CHARSETS = {"iso-8859-7", "iso8859-7", "windows-1253", "cp1253", "greek"}
BOM = "﻿"


def charset_evidence(lines: DataFrame) -> DataFrame:
    """One row of counts that decide the charset of text lines read as raw bytes."""
    return lines.agg(*_charset_counts())


def _charset_counts() -> list[Column]:
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    undefined = [
        F.sum(F.regexp_count(latin, F.lit(p))).alias(f"undefined_{name}") for name, p in UNDEFINED_BYTES.items()
    ]
    return [
        F.count("*").alias("lines"),
        F.count_if(~F.is_valid_utf8("value")).alias("bad_utf8"),
        F.count_if(F.col("value").startswith(BOM)).alias("bom"),
        F.sum(F.regexp_count(latin, F.lit(HEBREW_BYTES))).alias("hebrew"),
        F.sum(F.regexp_count(latin, F.lit(GREEK_BYTES))).alias("greek"),
        *undefined,
    ]


def _charset() -> Column:
    """UTF-8 when all bytes are valid, else the first single-byte charset that defines all of them."""
    out = F.when(F.col("bad_utf8") == 0, "UTF-8")
    for name in UNDEFINED_BYTES:
        out = out.when(F.col(f"undefined_{name}") == 0, name)
    return out.otherwise("ISO-8859-1")


def detect_charset(spark: SparkSession, path, guess: str | None = None) -> str:
    """Charset of a file, from all its lines.

    A Greek ``guess`` of another detector is overruled when the bytes hold at least as many Hebrew as
    Greek letters.
    """
    row = charset_evidence(spark.read.text(path)).withColumn("charset", _charset()).first()
    if guess and guess.lower().replace("_", "-") in GREEK_CHARSETS:
        return "windows-1255" if row["hebrew"] and row["hebrew"] >= row["greek"] else guess
    return row["charset"]


def dialect_evidence(lines: DataFrame) -> DataFrame:
    """One row: occurrences of every delimiter and of decimal points and commas."""
    return lines.agg(*_dialect_counts())


def _dialect_counts() -> list[Column]:
    count = lambda d: F.sum(F.length("value") - F.length(F.translate("value", d, "")))
    return [
        *[count(d).alias(f"d{i}") for i, d in enumerate(DELIMITERS)],
        F.sum(F.regexp_count("value", F.lit(r"\d+\.\d+"))).alias("points"),
        F.sum(F.regexp_count("value", F.lit(r"\d+,\d+"))).alias("commas"),
    ]


def _dialect() -> dict[str, Column]:
    """Most frequent delimiter, the first of equals; decimal comma only when it is not the delimiter too."""
    counts = [F.coalesce(F.col(f"d{i}"), F.lit(0)) for i in range(len(DELIMITERS))]
    most = F.greatest(*counts)
    delimiter = F.when(most == 0, ",")
    for i, d in enumerate(DELIMITERS):
        delimiter = delimiter.when(counts[i] == most, d)
    comma = (F.coalesce("commas", F.lit(0)) > F.coalesce("points", F.lit(0))) & (delimiter != ",")
    return {"delimiter": delimiter, "decimal": F.when(comma, ",").otherwise(".")}


def detect_dialect(spark: SparkSession, path) -> dict[str, str]:
    """Delimiter and decimal sign of a file, from all its lines."""
    row = dialect_evidence(spark.read.text(path)).select(*[c.alias(k) for k, c in _dialect().items()]).first()
    return row.asDict()


def file_formats(spark: SparkSession, path) -> DataFrame:
    """``charset``, ``delimiter``, ``decimal`` and ``files``: the files of each format, decided from all lines of a file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    counted = lines.groupBy("file").agg(*_charset_counts(), *_dialect_counts())
    named = counted.select("file", _charset().alias("charset"), *[c.alias(k) for k, c in _dialect().items()])
    return named.groupBy("charset", "delimiter", "decimal").agg(F.sort_array(F.collect_list("file")).alias("files"))


def source_order() -> Column:
    """Orderable position of a row in its input files, for keep-first rules."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )


def scan(
    spark: SparkSession,
    paths: str | list[str],
    delimiter: str = ",",
    decimal: str = ".",
    encoding: str = "UTF-8",
    text_ids: bool | None = None,
) -> DataFrame:
    """Typed observations under normalised names, plus ``_row`` (file position).

    All columns are read as text and cast leniently. ``data_id`` is BIGINT when every id is a whole number and else
    stays text; without ``text_ids`` one look at that column decides. windows-1255 input needs
    ``spark.sql.legacy.javaCharsets=true``.
    """
    order = _raw(spark, paths, delimiter, encoding)
    return cleaning.type_columns(order, decimal, cleaning.has_text_ids(order) if text_ids is None else text_ids)


def _raw(spark: SparkSession, paths: str | list[str], delimiter: str, encoding: str) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding)
    raw = reader.option("enforceSchema", False).csv(paths)
    placed = raw.select("*", source_order().alias("_row"))
    renamed = cleaning.require_columns(cleaning.normalize_columns(placed.drop("_row")))
    return placed.withColumnsRenamed(dict(zip(raw.columns, renamed.columns)))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """:func:`scan` with charset and dialect found for every file; files of different formats are scanned apart."""
    # one row for each combination of charset, delimiter and decimal sign
    formats = file_formats(spark, path).orderBy("charset", "delimiter", "decimal").collect()
    if len(formats) <= 1:
        f = formats[0] if formats else {"charset": "UTF-8", "delimiter": ",", "decimal": "."}
        return scan(spark, path, f["delimiter"], f["decimal"], f["charset"])
    raws = [_raw(spark, list(f["files"]), f["delimiter"], f["charset"]) for f in formats]
    text_ids = any([cleaning.has_text_ids(r) for r in raws])
    typed = [cleaning.type_columns(r, f["decimal"], text_ids) for r, f in zip(raws, formats, strict=True)]
    out = typed[0]
    for part in typed[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def date_range(df: DataFrame, column: str = "timestamp", now_year: int | None = None, span: int = 10) -> DataFrame:
    """One row: first and last date and the number of usable timestamps.

    With ``now_year``, years more than ``span`` away from it count as unusable.
    """
    day = F.to_date(column)
    if now_year is not None:
        day = F.when(F.year(day).between(now_year - span, now_year + span), day)
    return df.agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"), F.count(day).alias("n_rows"))
