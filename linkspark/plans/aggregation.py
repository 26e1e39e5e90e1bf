"""Batch run: observation files to hourly and weekly rollups with their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkspark.config import AggregationParams
from linkspark.functions.temporal import localize
from linkspark.operators import cleaning, filters, rollup, temporal
from linkspark.sources import csv, holidays, sinks


ROLLUP_INPUT = [
    "name", "date", "hour_of_day", "daytype", "is_valid", "duration", "static_duration", "distance", "speed",
]


def prepare(
    df: DataFrame, params: AggregationParams, calendar: DataFrame | None = None, order=None, seen: Observation | None = None
) -> DataFrame:
    """Cleaned observations with all temporal attributes.

    Text timestamps are read row by row, the layout that leads in the file (``_file``) or the input first, and placed in the
    zone of the run. Rows whose text no layout fits stay, with a NULL timestamp and the text in ``_unresolved``. Everything is
    lazy. ``seen`` gets counts of the rows before they are deduplicated, when the result is written.
    """
    if dict(df.dtypes).get("timestamp") == "string":
        df = parsed(df, params)
    if seen is not None:
        if "_unresolved" not in df.columns:
            df = df.withColumn("_unresolved", F.lit(None).cast("string"))
        df = df.observe(seen, *_ingest_figures(), *cleaning.rule_counts(params, df))
    order = order or [c for c in ("_row", "data_id") if c in df.columns][:1]
    return df.transform(cleaning.clean, params, order).transform(temporal.enhance, params, calendar)


def parsed(df: DataFrame, params: AggregationParams) -> DataFrame:
    """Text timestamps as local times of ``params.timezone``; ``_unresolved`` keeps the text of those that cannot be read."""
    by = "_file" if "_file" in df.columns else None
    out = temporal.resolve_timestamps(df, params.timestamp_format, timezone=params.timezone, by=by)
    return out.withColumn("timestamp", localize(F.col("timestamp"), params.timezone))


def ingest_counts(raw: DataFrame, params: AggregationParams) -> DataFrame:
    """One row: rows read, and rows whose timestamp is there but could not be parsed."""
    if dict(raw.dtypes).get("timestamp") != "string":
        return raw.agg(F.count(F.lit(1)).alias("rows_read"), F.lit(0).cast("bigint").alias("unparsed_timestamps"))
    return parsed(raw, params).agg(*_ingest_figures())


def _ingest_figures() -> list:
    return [F.count(F.lit(1)).alias("rows_read"), F.count("_unresolved").alias("unparsed_timestamps")]


def rollups(df: DataFrame, params: AggregationParams) -> tuple[DataFrame, DataFrame]:
    """Hourly and weekly tables of prepared observations."""
    selected = filters.select_observations(df, params)
    hourly = rollup.hourly_aggregation(selected, params.min_valid_per_hour)
    return hourly, _weekly(selected, hourly, params)


def _weekly(selected: DataFrame, hourly: DataFrame, params: AggregationParams) -> DataFrame:
    if params.recompute_std_from_raw:
        return rollup.weekly_with_pooled_std(selected, hourly, params.weekly_grouping, params.min_valid_per_hour)
    return rollup.weekly_profile(hourly, params.weekly_grouping)


def run(
    spark: SparkSession,
    input_path: str,
    output_dir: str,
    params: AggregationParams = AggregationParams(),
    national_holidays: DataFrame | None = None,
    custom_holidays: str | None = None,
    run_id: str = "run",
) -> dict[str, str]:
    """Read, clean, roll up and write everything; returns ``{output: folder}``.

    The typed rows, the cleaned rows (rollup columns only) and the hourly table are written and read back: the text
    files are read once to find their format and once to be parsed, rows are deduplicated once, and every report starts from
    the smallest stored table. Counts of the input and of broken rules are observed in the write of the cleaned rows. A
    task that is run again after an executor was lost may be observed twice; the tables themselves are not touched by that.
    ``performance`` has the seconds and the rows of every output. Rows whose timestamp no layout fits are in ``unresolved``.
    """
    params.check()
    log = sinks.RunLog(spark)
    typed = csv.read_observations(spark, input_path)
    typed_path = sinks.write_parquet(typed, f"{output_dir}/typed")
    raw = spark.read.parquet(typed_path)
    calendars = [national_holidays] if national_holidays is not None else []
    if custom_holidays:
        calendars.append(holidays.read_custom(spark, custom_holidays))
    calendar = temporal.holiday_calendar(*calendars) if calendars else None
    seen = Observation("input")
    cleaned = filters.select_observations(prepare(raw, params, calendar, seen=seen), params)

    out = {name: f"{output_dir}/{name}" for name in (
        "observations", "hourly", "hourly_csv", "weekly_csv", "quality_by_link", "invalid_reasons", "run_summary",
        "valid_hours_by_daytype", "run_config", "raw_preview", "hourly_preview", "weekly_preview", "hourly_check", "ingest",
        "unresolved", "performance",
    )}
    with log.step("observations"):
        sinks.write_parquet(cleaned.select(*[c for c in ROLLUP_INPUT if c in cleaned.columns]), out["observations"])
    counts = seen.get
    log.rows("observations", counts["rows_read"])
    prepared = spark.read.parquet(out["observations"])
    hourly = rollup.hourly_aggregation(prepared, params.min_valid_per_hour)
    with log.step("hourly"):
        sinks.write_parquet(hourly, out["hourly"], ["date"])
    stored = spark.read.parquet(out["hourly"])
    with log.step("weekly"):
        weekly_path = sinks.write_parquet(_weekly(prepared, stored, params), f"{output_dir}/weekly")
    weekly = spark.read.parquet(weekly_path)
    if params.write_parquet:
        out["weekly"] = weekly_path
    if cleaning.validity_method(raw.columns) == "numeric_range_rules":
        rules = list(cleaning.range_rules(raw, params))
        reasons = spark.createDataFrame([(r, counts[r]) for r in rules], "invalid_reason string, count bigint")
        reasons = reasons.orderBy(F.desc("count"), "invalid_reason")
    else:
        reasons = cleaning.invalid_reason_table(raw, params)
    absent = rollup.check_hourly_columns(stored.columns)
    figures = [(counts["rows_read"], counts["unparsed_timestamps"], ", ".join(absent) or "complete")]
    ingest = spark.createDataFrame(figures, "rows_read bigint, unparsed_timestamps bigint, hourly_columns string")
    unresolved = spark.createDataFrame([], "name string, timestamp string")
    if counts["unparsed_timestamps"]:
        lost = parsed(raw.select(*[c for c in ("name", "timestamp", "_file") if c in raw.columns]), params).where("_unresolved IS NOT NULL")
        unresolved = lost.select("name", F.col("_unresolved").alias("timestamp"))
    group = params.weekly_grouping
    reports = {
        "hourly_csv": lambda path: sinks.write_hourly_csv(stored, path),
        "weekly_csv": lambda path: sinks.write_weekly_csv(weekly, path),
        "quality_by_link": lambda path: sinks.write_csv(rollup.quality_by_link(prepared, stored), path, ["link_id"]),
        "invalid_reasons": lambda path: sinks.write_csv(reasons, path),
        "run_summary": lambda path: rollup.run_summary(prepared, stored, weekly).write.mode("overwrite").json(path),
        "hourly_check": lambda path: sinks.write_csv(rollup.hourly_contract(stored), path, ["rule"]),
        "ingest": lambda path: ingest.write.mode("overwrite").json(path),
        "unresolved": lambda path: sinks.write_csv(unresolved, path),
        "raw_preview": lambda path: sinks.write_csv(rollup.preview(raw.drop("_row"), ["data_id"]), path),
        "valid_hours_by_daytype": lambda path: sinks.write_csv(rollup.valid_hours_by_daytype(stored), path, ["daytype"]),
        "hourly_preview": lambda path: sinks.write_csv(rollup.preview(stored, ["link_id", "date", "hour_of_day"]), path),
        "weekly_preview": lambda path: sinks.write_csv(rollup.preview(weekly, ["link_id", group, "hour_of_day"]), path),
    }
    for name, write in reports.items():
        with log.step(name):
            write(out[name])
    sinks.write_run_config(spark, params, out["run_config"], run_id=run_id, input=input_path)
    log.write(out["performance"], run_id)
    return out


def date_probe(spark: SparkSession, input_path: str, params: AggregationParams = AggregationParams()) -> DataFrame:
    """Date range of a file, before a run."""
    raw = csv.read_observations(spark, input_path)
    fmt = temporal.choose_timestamp_format(raw, "timestamp", params.timestamp_format)
    return csv.date_range(temporal.parse_timestamps(raw, fmt).select(F.col("timestamp")))
