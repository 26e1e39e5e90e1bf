"""Writers. Spark writes in parallel; every writer returns the folder it wrote."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark import schema
from linkspark.functions.geometry import number_text, to_wkt

BOM = "﻿"


def fixed(value: Column, digits: int = 6) -> Column:
    """Number text with a fixed number of decimals, NULL for NULL."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))


def significant(value: Column, digits: int = 6) -> Column:
    """Number text like C's ``%g``: significant digits without trailing zeros, with an exponent outside 1e-4 to 1e6."""
    text = F.format_string(f"%.{digits - 1}e", value)
    power = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int")
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.coalesce(*[F.when(power == e, bare(F.format_string(f"%.{digits - 1 - e}f", value))) for e in range(-4, digits)])
    scientific = F.concat(bare(F.split_part(text, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(text, F.lit("e"), F.lit(2)))
    usual = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(usual, F.coalesce(F.when(value == 0, F.lit("0")), plain, scientific)).otherwise(value.cast("string"))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, bom: bool = False, numbers=None) -> str:
    """Headed CSV; NULL is empty, ``order`` sorts globally, ``numbers`` formats the doubles."""
    out = df.orderBy(*[F.asc_nulls_last(c) for c in order]) if order else df
    if numbers:
        out = out.select(*[numbers(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
    if bom:
        # the byte-order mark is the first character of the header line
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return path


def write_hourly_csv(hourly: DataFrame, path: str) -> str:
    columns = [c for c in schema.HOURLY_COLUMNS if c in hourly.columns]
    return write_csv(hourly.select(*columns), path, ["link_id", "date", "hour_of_day"], numbers=fixed)


def write_weekly_csv(weekly: DataFrame, path: str) -> str:
    columns = [c for c in schema.WEEKLY_COLUMNS if c in weekly.columns]
    group = "daytype" if "daytype" in columns else "weekday_index"
    return write_csv(weekly.select(*columns), path, ["link_id", group, "hour_of_day"])


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Parquet; rows of a partition meet in few files, and big partitions are split by size."""
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return path
    df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_extract_csv(df: DataFrame, path: str) -> str:
    """Validation extract: byte-order mark, six significant digits, sorted by link and time."""
    order = [c for c in ("link_id", "name", "timestamp", "date", "requested_time", "route_alternative") if c in df.columns]
    flat = df.drop(*[c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))])
    return write_csv(flat, path, order, bom=True, numbers=significant)


def report_columns(report: DataFrame) -> DataFrame:
    """Link report in its output order, under its output names."""
    named = report.withColumnsRenamed({"from_id": "From", "to_id": "To"})
    return named.select(*[c for c in schema.REPORT_COLUMNS if c in named.columns])


def short_names(report: DataFrame) -> DataFrame:
    """Column names of at most ten characters."""
    return report.withColumnsRenamed(schema.REPORT_SHORT_NAMES)


def geojson_features(df: DataFrame, line: str = "line") -> DataFrame:
    """One GeoJSON feature text per row; coordinates have plain decimals, a NULL line leaves them out."""
    properties = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != line]))

    def number(x: Column) -> Column:
        finite = F.abs(x) < float("inf")
        return F.when(x.isNull(), "null").when(finite, number_text(x)).otherwise(F.concat(F.lit('"'), x.cast("string"), F.lit('"')))

    points = F.transform(line, lambda p: F.concat(F.lit("["), number(p["x"]), F.lit(","), number(p["y"]), F.lit("]")))
    coordinates = F.coalesce(F.concat(F.lit(',"coordinates":['), F.array_join(points, ","), F.lit("]")), F.lit(""))
    opened = [F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"LineString"')]
    return df.select(F.concat(*opened, coordinates, F.lit("}}")).alias("value"))


def write_geojson_lines(df: DataFrame, path: str, line: str = "line") -> str:
    geojson_features(df, line).write.mode("overwrite").text(path)
    return path


def wkt_table(df: DataFrame, line: str = "line") -> DataFrame:
    """Attribute rows with the line as WKT ``geometry``."""
    return df.withColumn("geometry", to_wkt(F.col(line))).drop(line)


def write_wkt_csv(df: DataFrame, path: str, line: str = "line") -> str:
    return write_csv(wkt_table(df, line), path)


def write_sidecar(df: DataFrame, path: str, **facts) -> str:
    """One JSON row: row count, columns and export facts."""
    row = df.agg(F.count("*").alias("record_count")).withColumns(
        {"columns": F.array(*[F.lit(c) for c in df.columns])} | {k: F.lit(str(v)) for k, v in facts.items()}
    )
    row.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_run_config(spark, params, path: str, **facts) -> str:
    """Parameters of a run as one JSON text."""
    body = {k: v if isinstance(v, (str, int, float, bool, list, dict, type(None))) else str(v) for k, v in asdict(params).items()}
    text = json.dumps({**body, "_metadata": facts}, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


class RunLog:
    """Seconds and rows of the steps of a run, in the order in which they ended."""

    def __init__(self, spark):
        self.spark = spark
        self.steps: dict[str, list] = {}

    @contextmanager
    def step(self, name: str):
        begin = time.perf_counter()
        yield
        self.steps[name] = [round(time.perf_counter() - begin, 3), None]

    def rows(self, name: str, count: int) -> None:
        self.steps[name][1] = count

    def table(self, run_id: str = "run") -> DataFrame:
        """``run_id, position, step, seconds, rows, rows_per_sec`` and a last step ``total``."""
        steps = [(name, *values) for name, values in self.steps.items()]
        steps.append(("total", round(sum(x[1] for x in steps), 3), next((x[2] for x in steps if x[2] is not None), None)))
        rows = [(run_id, i, *x, round(x[2] / x[1], 1) if x[2] is not None and x[1] else None) for i, x in enumerate(steps, 1)]
        return self.spark.createDataFrame(rows, "run_id string, position int, step string, seconds double, rows bigint, rows_per_sec double")

    def write(self, path: str, run_id: str = "run") -> str:
        return write_csv(self.table(run_id), path, ["position"])
