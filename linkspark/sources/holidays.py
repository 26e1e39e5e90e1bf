"""Holiday calendars from text and calendar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TEXT_NAME, DEFAULT_EVENT_NAME = "Custom Holiday ", "Custom Holiday"


def from_text_lines(lines: DataFrame) -> DataFrame:
    """``YYYY-MM-DD name`` lines, with an optional dash or comma; comments and other lines are skipped."""
    line = F.trim("value")
    rest = F.trim(F.regexp_replace(F.trim(F.substr(line, F.lit(11))), r"^[-,]", ""))
    text = F.substring(line, 1, 10)
    parsed = lines.where(line.rlike(r"^\d{4}-\d{2}-\d{2}")).select(
        F.try_to_date(text, "yyyy-MM-dd").alias("date"),
        F.when(rest == "", F.concat(F.lit(DEFAULT_TEXT_NAME), text)).otherwise(rest).alias("name"),
    )
    return parsed.where("date IS NOT NULL")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return from_text_lines(spark.read.text(path))


def from_events(blocks: DataFrame) -> DataFrame:
    """Text rows ``value``, each ending one calendar event; the start may be a date or a date-time."""
    event = F.regexp_extract("value", r"(?s)BEGIN:VEVENT(.*)", 1)
    start = F.regexp_extract(event, r"(?m)^DTSTART[^:\r\n]*:\s*(\d{4})-?(\d{2})-?(\d{2})", 0)
    digits = F.substring(F.regexp_replace(F.regexp_extract(start, r":\s*([\d-]+)", 1), "-", ""), 1, 8)
    summary = F.trim(F.regexp_extract(event, r"(?m)^SUMMARY[^:\r\n]*:([^\r\n]*)", 1))
    parsed = blocks.where(start != "").select(
        F.try_to_date(digits, "yyyyMMdd").alias("date"),
        F.when(summary == "", DEFAULT_EVENT_NAME).otherwise(summary).alias("name"),
    )
    return parsed.where("date IS NOT NULL")


def read_ics(spark: SparkSession, path: str) -> DataFrame:
    """Calendar file, split into events by the reader."""
    return from_events(spark.read.option("lineSep", "END:VEVENT").text(path))


def read_custom(spark: SparkSession, path: str) -> DataFrame:
    return read_ics(spark, path) if path.lower().endswith(".ics") else read_text(spark, path)
