"""Stored rollups, under the column names of the map operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.rollup import to_map_columns


def read_rollup(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Parquet or headed CSV rollup."""
    if fmt == "parquet":
        return to_map_columns(spark.read.parquet(path))
    text = spark.read.option("header", True).csv(path)
    typed = {c: _csv_type(c) for c in text.columns}
    return to_map_columns(text.select(*[F.col(c).try_cast(t).alias(c) for c, t in typed.items()]))


def _csv_type(column: str) -> str:
    if column in ("link_id", "daytype"):
        return "string"
    if column == "date":
        return "date"
    if column in ("hour_of_day", "weekday_index", "no_valid_hour"):
        return "int"
    if column in ("n_total", "n_valid", "total_valid_n", "total_not_valid", "n_days"):
        return "bigint"
    return "boolean" if column == "valid_hour" else "double"


def newest_run(df: DataFrame, run_column: str = "run_id") -> DataFrame:
    """Rows of the latest run of a table that keeps several; prunes partitions when partitioned by run."""
    latest = df.agg(F.max(run_column).alias("run")).scalar()
    return df.where(F.col(run_column) == latest)
