"""Data-quality audit of map rollups: statistics, issue counts, scores, levels and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.config import QualityThresholds
from linkspark.functions import geometry
from linkspark.operators.network import match_counts
from linkspark.operators.quantiles import quantile_row

LIMITS = QualityThresholds()

# --- fixed values: least score per level ---
VALUE_LEVELS = [(95, "excellent"), (85, "good"), (70, "moderate")]
OBSERVATION_LEVELS = [(80, "excellent"), (60, "good"), (40, "moderate")]
OVERALL_LEVELS = [(90, "excellent"), (75, "good"), (60, "moderate")]


def level_of(score: Column, levels: list[tuple[float, str]], lowest: str = "poor") -> Column:
    (first, name), *rest = levels
    chain = F.when(score >= first, name)
    for limit, label in rest:
        chain = chain.when(score >= limit, label)
    return chain.otherwise(lowest)


def data_summary(links: DataFrame, results: DataFrame) -> DataFrame:
    """One row: sizes, links, and the date and hour coverage.

    Per-link and per-date counts are built side by side from one grouping.
    """
    cells = results.groupBy("link_id", "date", "hour").agg(F.count("*").alias("rows"))
    per_date = cells.groupBy("date").agg(
        F.sum("rows").alias("rows"),
        F.min("hour").alias("lo"),
        F.max("hour").alias("hi"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("hour"))).alias("mask"),
    )
    total = per_date.agg(
        F.sum("rows").alias("results_records"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count("date").alias("unique_dates"),
        F.min("lo").alias("min_hour"),
        F.max("hi").alias("max_hour"),
        F.bit_count(F.bit_or("mask")).alias("unique_hours"),
    )
    distinct = cells.select("link_id").where("link_id IS NOT NULL").distinct()
    return total.withColumns(
        {
            "network_features": links.agg(F.count("*").alias("n")).scalar(),
            "unique_link_ids": distinct.agg(F.count("*").alias("n")).scalar(),
        }
    )


def _statistics(df: DataFrame, column: str, issues: dict[str, Column], also: list[Column] | None = None) -> DataFrame:
    """One row: count, nulls, moments, range, quartiles and the issue counts of a column, and aggregates ``also``."""
    value = F.col(column)
    figures = [
        F.count(value).alias("count"),
        F.count_if(value.isNull()).alias("null_count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *[F.count_if(test).alias(name) for name, test in issues.items()],
        *(also or []),
    ]
    row = quantile_row(df, {"__q": (column, [0.25, 0.5, 0.75])}, figures)
    return row.withColumns({"q25": F.col("__q")[0], "median": F.col("__q")[1], "q75": F.col("__q")[2]}).drop("__q")


def _scored(stats: DataFrame, bad: Column) -> DataFrame:
    score = F.when(F.col("count") > 0, F.greatest(F.lit(0.0), 100.0 - bad * 100.0 / F.col("count")))
    return stats.withColumn("quality_score", score).withColumn(
        "quality_level", F.when(score.isNotNull(), level_of(score, VALUE_LEVELS))
    )


def speed_quality(results: DataFrame, limits: QualityThresholds = LIMITS) -> DataFrame:
    """Speed statistics; non-positive and very high speeds lower the score."""
    v = F.col("avg_speed_kmh")
    issues = {
        "non_positive": v <= 0,
        "extreme_low": (v > 0) & (v < limits.extreme_low_speed),
        "extreme_high": v > limits.extreme_high_speed,
        "out_of_range": (v < limits.min_valid_speed) | (v > limits.max_valid_speed),
    }
    stats = _statistics(results, "avg_speed_kmh", issues)
    return _scored(stats, F.col("non_positive") + F.col("extreme_high"))


def duration_quality(results: DataFrame, limits: QualityThresholds = LIMITS) -> DataFrame:
    """Duration statistics; non-positive and very long durations lower the score."""
    v = F.col("avg_duration_sec")
    issues = {
        "non_positive": v <= 0,
        "extreme_short": (v > 0) & (v < limits.extreme_short_duration),
        "extreme_long": v > limits.extreme_long_duration,
        "out_of_range": (v < limits.min_valid_duration) | (v > limits.max_valid_duration),
    }
    stats = _statistics(results, "avg_duration_sec", issues)
    minutes = {"mean_minutes": F.col("mean") / 60, "median_minutes": F.col("median") / 60}
    return _scored(stats, F.col("non_positive") + F.col("extreme_long")).withColumns(minutes)


def observation_quality(results: DataFrame, limits: QualityThresholds = LIMITS) -> DataFrame:
    """Observation counts; the score is the share of reliable rows."""
    v = F.col("n_valid")
    issues = {
        "critical": v < limits.min_observations_critical,
        "sparse": (v >= limits.min_observations_critical) & (v < limits.min_observations_sparse),
        "unreliable": v < limits.min_observations_reliable,
        "reliable": v >= limits.min_observations_reliable,
    }
    stats = _statistics(results, "n_valid", issues, [F.sum("n_valid").alias("total_observations")])
    score = F.col("reliable") * 100.0 / F.nullif(F.col("count"), F.lit(0))
    return stats.withColumn("quality_score", score).withColumn(
        "quality_level", F.when(score.isNotNull(), level_of(score, OBSERVATION_LEVELS))
    )


def geometry_quality(lines: DataFrame, limits: QualityThresholds = LIMITS) -> DataFrame:
    """Line statistics; unusable and very long lines lower the score.

    A line is unusable when it has fewer than two distinct vertices.
    """
    usable = F.coalesce((F.size("line") >= 2) & (F.size(F.array_distinct("line")) >= 2), F.lit(False))
    measured = lines.select(
        usable.alias("usable"),
        F.col("line").isNull().alias("absent"),
        F.when(usable, geometry.line_length(F.col("line"))).alias("length"),
    ).withColumn("positive", F.when(F.col("length") > 0, F.col("length")))
    v = F.col("length")
    issues = {
        "total_features": F.lit(True),
        "invalid": ~F.col("usable") & ~F.col("absent"),
        "null_geometries": F.col("absent"),
        "short_links": (v > 0) & (v < limits.min_length_m),
        "long_links": v > limits.max_length_m,
    }
    stats = _statistics(measured, "positive", issues)
    bad, total = F.col("invalid") + F.col("long_links"), F.col("total_features")
    score = F.when(total > 0, F.greatest(F.lit(0.0), 100.0 - bad * 100.0 / total))
    return stats.withColumn("quality_score", score).withColumn(
        "quality_level", F.when(score.isNotNull(), level_of(score, VALUE_LEVELS))
    )


def overall_quality(links_lines: DataFrame, results: DataFrame) -> DataFrame:
    """One row: component scores, their mean and the overall level."""
    score = lambda df: df.select("quality_score").scalar()
    speed = speed_quality(results).select(F.col("quality_score").alias("speed_score"))
    scored = speed.withColumns(
        {
            "duration_score": score(duration_quality(results)),
            "observation_score": score(observation_quality(results)),
            "geometry_score": score(geometry_quality(links_lines)),
        }
    )
    parts = F.array_compact(F.array("speed_score", "duration_score", "observation_score", "geometry_score"))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(parts), F.lit(0))
    out = scored.withColumn("overall_score", F.coalesce(mean, F.lit(0.0)))
    level = level_of(F.col("overall_score"), OVERALL_LEVELS)
    return out.withColumn("overall_level", F.when(mean.isNull(), "unknown").otherwise(level))


def warning_table(links: DataFrame, lines: DataFrame, results: DataFrame, limits: QualityThresholds = LIMITS) -> DataFrame:
    """``category, issue, severity, count, action`` for everything the audit found."""
    # fixed values: categories, texts, severities and actions
    review = "Review data collection and calculation methods"
    outliers = "Investigate outliers and consider data validation rules"
    more = "Increase observation frequency or extend collection period"
    none = "Review data quality procedures"
    speed_, duration_, obs_ = "Speed Quality", "Duration Quality", "Observation Quality"
    entries = [
        ("Missing Geometry", "%d result links have no shapefile geometry", "High", "missing_in_network",
         "Update shapefile or verify link_id format"),
        ("Missing Results", "%d shapefile links have no result data", "Medium", "missing_in_results",
         "Extend data collection or verify processing"),
        (speed_, "Found %d non-positive speed values", "Critical", "speed_non_positive", review),
        (speed_, f"Found %d extremely low speeds (< {limits.extreme_low_speed} km/h)", "Warning",
         "speed_extreme_low", outliers),
        (speed_, f"Found %d extremely high speeds (> {limits.extreme_high_speed} km/h)", "Warning",
         "speed_extreme_high", outliers),
        (speed_, f"Found %d speeds outside valid range ({limits.min_valid_speed}-{limits.max_valid_speed} km/h)",
         "Info", "speed_out_of_range", none),
        (duration_, "Found %d non-positive duration values", "Critical", "duration_non_positive", review),
        (duration_, f"Found %d extremely short durations (< {limits.extreme_short_duration} sec)", "Warning",
         "duration_extreme_short", outliers),
        (duration_, f"Found %d extremely long durations (> {limits.extreme_long_duration} sec)", "Warning",
         "duration_extreme_long", outliers),
        (duration_, f"Found %d durations outside valid range ({limits.min_valid_duration}-{limits.max_valid_duration} sec)",
         "Info", "duration_out_of_range", none),
        (obs_, f"Found %d links with critically low observations (< {limits.min_observations_critical})", "Critical",
         "critical", more),
        (obs_, f"Found %d links with sparse observations ({limits.min_observations_critical}-{limits.min_observations_sparse})",
         "Info", "sparse", more),
        (obs_, f"Found %d links with unreliable observation counts (< {limits.min_observations_reliable})", "Info",
         "unreliable", none),
        ("Geometry Quality", "Found %d invalid geometries", "Critical", "invalid", none),
        ("Geometry Quality", "Found %d null geometries", "Critical", "null_geometries", none),
        ("Geometry Quality", f"Found %d very short links (< {limits.min_length_m} m)", "Info", "short_links", none),
        ("Geometry Quality", f"Found %d very long links (> {limits.max_length_m} m)", "Info", "long_links", none),
    ]
    s, d, n = F.col("avg_speed_kmh"), F.col("avg_duration_sec"), F.col("n_valid")
    counts = results.agg(
        F.count_if(s <= 0).alias("speed_non_positive"),
        F.count_if((s > 0) & (s < limits.extreme_low_speed)).alias("speed_extreme_low"),
        F.count_if(s > limits.extreme_high_speed).alias("speed_extreme_high"),
        F.count_if((s < limits.min_valid_speed) | (s > limits.max_valid_speed)).alias("speed_out_of_range"),
        F.count_if(d <= 0).alias("duration_non_positive"),
        F.count_if((d > 0) & (d < limits.extreme_short_duration)).alias("duration_extreme_short"),
        F.count_if(d > limits.extreme_long_duration).alias("duration_extreme_long"),
        F.count_if((d < limits.min_valid_duration) | (d > limits.max_valid_duration)).alias("duration_out_of_range"),
        F.count_if(n < limits.min_observations_critical).alias("critical"),
        F.count_if(n.between(limits.min_observations_critical, limits.min_observations_sparse - 1)).alias("sparse"),
        F.count_if(n < limits.min_observations_reliable).alias("unreliable"),
    )
    match = match_counts(links, results)
    shapes = geometry_quality(lines, limits)
    one = lambda df, c: df.select(c).scalar()
    counts = counts.withColumns(
        {c: one(match, c) for c in ("missing_in_network", "missing_in_results")}
        | {c: one(shapes, c) for c in ("invalid", "null_geometries", "short_links", "long_links")}
    )
    table = F.array(
        *[
            F.when(
                F.col(c) > 0,
                F.struct(
                    F.lit(category).alias("category"),
                    F.format_string(layout, F.col(c)).alias("issue"),
                    F.lit(severity).alias("severity"),
                    F.col(c).cast("bigint").alias("count"),
                    F.lit(action).alias("action"),
                ),
            )
            for category, layout, severity, c, action in entries
        ]
    )
    return counts.select(F.inline(F.array_compact(table)))
