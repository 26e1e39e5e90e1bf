"""Hourly aggregates, weekly profiles and the reports built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark import schema
from linkspark.operators.quantiles import quantile_row

HOUR_KEYS = ["link_id", "date", "hour_of_day", "daytype"]


def _with_link(df: DataFrame) -> DataFrame:
    return df if "link_id" in df.columns else df.withColumnRenamed("name", "link_id")


def _keys_known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def hourly_aggregation(df: DataFrame, min_valid_per_hour: int = 1) -> DataFrame:
    """One row per link, date, hour and day type.

    Counts are over all rows, metrics over valid rows only, in one conditional aggregation with map-side
    partials. Hours without a valid row stay, with NULL metrics. Rows with a NULL key are left out.
    """
    rows = _with_link(df)
    valid = F.col("is_valid")

    def of_valid(column: str) -> Column:
        return F.when(valid, F.col(column))

    measures = [F.count("is_valid").alias("n_total"), F.count_if(valid).alias("n_valid")]
    layout = {
        "duration": [(F.avg, "avg_duration_sec"), (F.stddev_samp, "std_duration_sec")],
        "static_duration": [(F.avg, "avg_static_duration_sec"), (F.stddev_samp, "std_static_duration_sec")],
        "distance": [(F.avg, "avg_distance_m")],
        "speed": [(F.avg, "avg_speed_kmh")],
    }
    for column, outputs in layout.items():
        if column in rows.columns:
            measures += [agg(of_valid(column)).alias(name) for agg, name in outputs]
        elif column not in schema.OPTIONAL_COLUMNS:
            measures += [F.max(F.lit(None).cast("double")).alias(name) for _, name in outputs]
    grouped = rows.where(_keys_known(HOUR_KEYS)).groupBy(*HOUR_KEYS).agg(*measures)
    enough = F.col("n_valid") >= min_valid_per_hour
    flagged = grouped.withColumns({"valid_hour": enough, "no_valid_hour": (~enough).cast("int")})
    return flagged.select(*[c for c in schema.HOURLY_COLUMNS if c in flagged.columns])


def hourly_contract(hourly: DataFrame) -> DataFrame:
    """``rule, violations`` of the hourly layout, in one pass."""
    rules = {
        "hour_of_day outside 0-23": ~F.col("hour_of_day").between(0, 23),
        "n_valid above n_total": F.col("n_valid") > F.col("n_total"),
    }
    for column in [*HOUR_KEYS, "n_total", "n_valid"]:
        rules[f"null {column}"] = F.col(column).isNull()
    counted = hourly.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    return counted.unpivot([], [f"`{name}`" for name in rules], "rule", "violations")


def check_hourly_columns(columns: list[str]) -> list[str]:
    """Required columns of the hourly layout that are absent or out of order; optional ones may lack."""
    optional = {"avg_static_duration_sec", "std_static_duration_sec"}
    required = [c for c in schema.HOURLY_COLUMNS if c not in optional]
    present = [c for c in columns if c not in optional]
    return [] if present == required else [c for c in required if c not in present] or ["column order"]


def weekly_profile(hourly: DataFrame, grouping: str = "daytype") -> DataFrame:
    """Profile of valid hours per link, day type (or weekday) and hour.

    Metrics are unweighted means of the hourly values; counts cover valid hours only.
    """
    rows = hourly.where("valid_hour")
    if grouping == "weekday_index" and "weekday_index" not in rows.columns:
        rows = rows.withColumn("weekday_index", F.weekday("date"))
    keys = ["link_id", grouping, "hour_of_day"]
    # the hourly key has the date and the day type, so by day type every date is one row of its cell;
    # by weekday a date may have rows of several day types
    measures = [
        F.avg("n_valid").alias("avg_n_valid"),
        F.sum("n_valid").alias("total_valid_n"),
        F.sum(F.col("n_total") - F.col("n_valid")).alias("total_not_valid"),
    ]
    means = {
        "avg_dur": "avg_duration_sec",
        "std_dur": "std_duration_sec",
        "avg_static_dur": "avg_static_duration_sec",
        "std_static_dur": "std_static_duration_sec",
        "avg_dist": "avg_distance_m",
        "avg_speed": "avg_speed_kmh",
    }
    measures += [F.avg(source).alias(name) for name, source in means.items() if source in rows.columns]
    days = F.count("*") if grouping == "daytype" else F.count_distinct("date")
    profile = rows.where(_keys_known(keys)).groupBy(*keys).agg(*measures, days.alias("n_days"))
    return profile.select(*[c for c in schema.WEEKLY_COLUMNS if c in profile.columns])


def pooled_std(df: DataFrame, grouping: str = "daytype", min_valid_per_hour: int = 1) -> DataFrame:
    """Sample standard deviation of the raw valid durations of valid hours, per profile cell.

    Hours are summarised first (count, mean, variance); a cell then holds at most one summary per date
    and day type, and the summaries combine exactly.
    """
    rows = _with_link(df).where(_keys_known(HOUR_KEYS))
    duration = F.when(F.col("is_valid"), F.col("duration"))
    hours = (
        rows.groupBy(*HOUR_KEYS)
        .agg(
            F.count_if("is_valid").alias("n_valid"),
            F.count(duration).alias("n"),
            F.avg(duration).alias("m"),
            F.var_pop(duration).alias("v"),
        )
        .where((F.col("n_valid") >= min_valid_per_hour))
    )
    if grouping == "weekday_index":
        hours = hours.withColumn("weekday_index", F.weekday("date"))
    parts = F.collect_list(F.when(F.col("n") > 0, F.struct("n", "m", "v")))
    cells = hours.groupBy("link_id", grouping, "hour_of_day").agg(parts.alias("parts"))
    zero = F.lit(0.0)
    total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"])
    cells = cells.withColumn("n", total)
    mean = F.aggregate("parts", zero, lambda acc, p: acc + p["n"] * p["m"]) / F.nullif(F.col("n"), F.lit(0))
    cells = cells.withColumn("mean", mean)
    squares = F.aggregate(
        "parts",
        zero,
        lambda acc, p: acc + p["n"] * (p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))),
    )
    std = F.when(F.col("n") > 1, F.sqrt(squares / (F.col("n") - 1)))
    return cells.select("link_id", grouping, "hour_of_day", F.col("n").alias("n_raw"), std.alias("std_dur"))


def weekly_with_pooled_std(
    df: DataFrame, hourly: DataFrame, grouping: str = "daytype", min_valid_per_hour: int = 1
) -> DataFrame:
    """Weekly profile whose ``std_dur`` is the pooled one."""
    profile = weekly_profile(hourly, grouping)
    keys = ["link_id", grouping, "hour_of_day"]
    pooled = pooled_std(df, grouping, min_valid_per_hour).drop("n_raw")
    return profile.drop("std_dur").join(pooled, keys, "left").select(*profile.columns)


def quality_by_link(df: DataFrame, hourly: DataFrame) -> DataFrame:
    """Validity and hour coverage per link."""
    raw = (
        _with_link(df)
        .groupBy("link_id")
        .agg(F.count("*").alias("rows"), F.count_if("is_valid").alias("valid_rows"))
    )
    by_day = hourly.groupBy("link_id", "date").agg(
        F.count("*").alias("hours"), F.count_if("valid_hour").alias("valid_hours")
    )
    hours = by_day.groupBy("link_id").agg(
        F.sum("hours").alias("hours_with_data"),
        F.sum("valid_hours").alias("hours_valid"),
        F.count("date").alias("days_covered"),
    )
    joined = raw.join(hours, "link_id", "left").na.fill(0, ["hours_with_data", "hours_valid", "days_covered"])
    hours_share = F.when(
        F.col("hours_with_data") > 0, F.col("hours_valid") * 100.0 / F.col("hours_with_data")
    ).otherwise(0.0)
    return joined.select(
        "link_id",
        F.round(F.col("valid_rows") * 100.0 / F.col("rows"), 2).alias("percent_valid"),
        "hours_with_data",
        "hours_valid",
        (F.col("hours_with_data") - F.col("hours_valid")).alias("hours_dropped"),
        F.round(hours_share, 2).alias("percent_valid_hours"),
        "days_covered",
    )


def run_summary(df: DataFrame, hourly: DataFrame, weekly: DataFrame) -> DataFrame:
    """One row: sizes, validity, links, and the distribution of ``n_valid`` per hour."""
    links = _with_link(df).groupBy("link_id").agg(
        F.count("*").alias("rows"), F.count_if("is_valid").alias("valid")
    )
    raw = links.agg(
        F.sum("rows").alias("raw_rows"),
        F.sum("valid").alias("valid_rows"),
        F.count("link_id").alias("distinct_links"),
    )
    figures = [
        F.count("*").alias("rows"),
        F.min("n_valid").alias("lo"),
        F.avg("n_valid").alias("mean"),
        F.max("n_valid").alias("hi"),
    ]
    spread = quantile_row(hourly, {"median": ("n_valid", [0.5])}, figures)
    row = raw.withColumns(
        {"spread": spread.select(F.struct("*").alias("s")).scalar(), "weekly_rows": weekly.agg(F.count("*").alias("n")).scalar()}
    )
    return row.select(
        "raw_rows",
        F.col("spread.rows").alias("hourly_rows"),
        "weekly_rows",
        "valid_rows",
        (F.col("raw_rows") - F.col("valid_rows")).alias("invalid_rows"),
        F.round(F.col("valid_rows") * 100.0 / F.col("raw_rows"), 1).alias("valid_percent"),
        "distinct_links",
        F.col("spread.lo").alias("n_valid_min"),
        F.round("spread.mean", 1).alias("n_valid_mean"),
        F.round(F.col("spread.median")[0], 1).alias("n_valid_median"),
        F.col("spread.hi").alias("n_valid_max"),
    )


def valid_hours_by_daytype(hourly: DataFrame) -> DataFrame:
    return hourly.where("valid_hour").groupBy("daytype").agg(F.count("*").alias("valid_hours"))


# --- map rollups: link_id, date, hour, avg_duration_sec, avg_speed_kmh, n_valid ---


def to_map_columns(rollup: DataFrame) -> DataFrame:
    """Rollup under the column names that the map operators use."""
    return rollup.withColumnsRenamed(
        {old: new for old, new in schema.ROLLUP_VARIANTS.items() if old in rollup.columns}
    )


def map_weekly(hourly: DataFrame, method: str = "median", weighted: bool = False) -> DataFrame:
    """Link and hour over all dates: mean or median of every numeric column, ``n_valid`` summed.

    A cell has one row per date and day type, so the exact median gathers at most that many values.
    ``weighted`` weighs means by ``n_valid``.
    """
    if method not in ("mean", "median"):
        raise ValueError("method must be 'mean' or 'median'")
    numeric = [
        c for c, t in hourly.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")
    ]
    measures = []
    for column in numeric:
        if column == "hour":
            continue
        if column == "n_valid":
            measure = F.sum(column)
        elif method == "median":
            measure = F.median(column)
        elif weighted:
            known = F.col(column).isNotNull()
            weight = F.sum(F.when(known, F.col("n_valid")))
            measure = F.sum(F.col(column) * F.col("n_valid")) / F.nullif(weight, F.lit(0))
        else:
            measure = F.avg(column)
        measures.append(measure.alias(column))
    return hourly.where(_keys_known(["link_id", "hour"])).groupBy("link_id", "hour").agg(*measures)


def date_span(hourly: DataFrame) -> DataFrame:
    """First and last date, number of distinct dates."""
    days = hourly.select("date").where("date IS NOT NULL").distinct()
    span = days.agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_days")
    )
    return span.withColumn("date_range_str", F.concat_ws(" to ", "start_date", "end_date"))


def link_detail(hourly: DataFrame) -> DataFrame:
    """Observations, coverage lists and a quality label for every link."""
    days = hourly.groupBy("link_id", "date", "hour").agg(
        F.sum("n_valid").alias("n_valid"), F.count("*").alias("rows")
    )
    detail = days.groupBy("link_id").agg(
        F.sum("n_valid").alias("total_observations"),
        F.sum("rows").alias("rows"),
        F.array_sort(F.collect_set("date")).alias("date_coverage"),
        F.array_sort(F.collect_set("hour")).alias("hour_coverage"),
    )
    total = F.col("total_observations")
    label = (
        F.when(total == 0, "no_data")
        .when(total < 10, "sparse")
        .when(F.col("rows") < 5, "limited")
        .when(total < 50, "moderate")
        .otherwise("good")
    )
    return detail.select(
        "link_id",
        "total_observations",
        F.size("date_coverage").alias("unique_dates"),
        F.size("hour_coverage").alias("unique_hours"),
        "date_coverage",
        "hour_coverage",
        label.alias("data_quality"),
    )


def hour_pattern(hourly: DataFrame, metric: str, method: str = "median") -> DataFrame:
    """Per link: the value of each hour of the day and the statistics of that daily curve."""
    value = F.median(metric) if method == "median" else F.avg(metric)
    curve = hourly.groupBy("link_id", "hour").agg(value.alias("value"))
    known = F.col("value").isNotNull()
    by_value = F.struct("value", -F.col("hour"))
    low_first = F.struct("value", "hour")
    pattern = curve.groupBy("link_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour", "value")))).alias("hourly_values"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("std_value"),
        F.max_by("hour", F.when(known, by_value)).alias("peak_hour"),
        F.min_by("hour", F.when(known, low_first)).alias("off_peak_hour"),
    )
    variation = F.when(F.col("mean_value") > 0, F.col("std_value") / F.col("mean_value")).otherwise(0.0)
    return pattern.withColumn("variation_coefficient", variation)


def aggregation_check(original: DataFrame, aggregated: DataFrame) -> DataFrame:
    """One row comparing a rollup with its input."""
    links = lambda df: df.select("link_id").where("link_id IS NOT NULL").distinct()
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    extremes = aggregated.agg(
        F.count("*").alias("aggregated_records"),
        F.count_if(F.col("avg_duration_sec") > 3600).alias("extreme_durations"),
        F.count_if(F.col("avg_speed_kmh") > 200).alias("extreme_speeds"),
    )
    lost = links(original).join(links(aggregated), "link_id", "left_anti")
    checked = extremes.select(
        count(original).alias("original_records"),
        "aggregated_records",
        count(links(original)).alias("links_processed"),
        count(links(aggregated)).alias("links_in_result"),
        count(lost).alias("lost_links"),
        "extreme_durations",
        "extreme_speeds",
    )
    ratio = F.when(
        F.col("original_records") > 0, F.col("aggregated_records") / F.col("original_records")
    ).otherwise(0.0)
    return checked.withColumns(
        {
            "compression_ratio": ratio,
            "low_compression": ratio > 0.8,
            "data_loss": F.col("links_in_result") < F.col("links_processed"),
        }
    )


def preview(df: DataFrame, keys: list[str], n: int = 100) -> DataFrame:
    """First ``n`` rows by ``keys``, nulls last."""
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys]).limit(n)


def rollup_completeness(hourly: DataFrame) -> DataFrame:
    """Missing metrics, date range and hour coverage of a map rollup."""
    days = hourly.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("avg_duration_sec").isNull()).alias("missing_duration"),
        F.count_if(F.col("avg_speed_kmh").isNull()).alias("missing_speed"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("hour")))).alias("hours_covered"),
        F.min("hour").alias("min_hour"),
        F.max("hour").alias("max_hour"),
    )
    share = lambda c: F.col(c) * 100.0 / F.col("records")
    return days.withColumns(
        {
            "missing_duration_percent": share("missing_duration"),
            "missing_speed_percent": share("missing_speed"),
            "total_days": F.datediff("end_date", "start_date") + 1,
        }
    )
