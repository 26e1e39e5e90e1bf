"""Key figures of a map selection and their change between two selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.operators.quality import level_of
from linkspark.operators.quantiles import quantile_row

# --- fixed values: label limits, reasonable ranges and the figures that changes are shown for ---
COVERAGE_LEVELS = [(90, "excellent"), (75, "good"), (50, "moderate")]
DAYS_LEVELS = [(30, "excellent"), (14, "good"), (7, "moderate")]
QUALITY_LEVELS = [(90, "excellent"), (75, "good"), (50, "moderate")]
LOW_OBSERVATIONS, MAX_SPEED, MAX_DURATION = 5, 200, 3600
TRACKED = [
    "coverage_percent", "mean_speed", "mean_duration", "n_links_rendered", "total_observations",
    "network_length_km", "data_quality_score",
]


def kpis(selection: DataFrame, network_links: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """One row of key figures.

    ``selection``: network rows joined with results (``avg_speed_kmh``, ``avg_duration_sec``, ``n_valid``,
    ``length_m``); ``network_links``: the whole network; ``days``: rows that carry the ``date`` span.
    """
    speed, seconds, n = F.col("avg_speed_kmh"), F.col("avg_duration_sec"), F.col("n_valid")
    minutes = seconds / 60
    figures = [
        F.count("*").alias("n_links_rendered"),
        F.avg(speed).alias("mean_speed"),
        F.stddev_samp(speed).alias("speed_std"),
        F.min(speed).alias("min_speed"),
        F.max(speed).alias("max_speed"),
        F.avg(minutes).alias("mean_duration"),
        F.stddev_samp(minutes).alias("duration_std"),
        F.min(minutes).alias("min_duration"),
        F.max(minutes).alias("max_duration"),
        F.sum(n).alias("total_observations"),
        F.avg(n).alias("mean_observations_per_link"),
        (F.sum("length_m") / 1000).alias("network_length_km"),
        F.avg("length_m").alias("mean_link_length_m"),
        (F.count_if(n < LOW_OBSERVATIONS) / F.nullif(F.count("*"), F.lit(0))).alias("__sparse"),
        (F.count_if((speed > 0) & (speed <= MAX_SPEED)) / F.nullif(F.count(speed), F.lit(0))).alias("__speed_ok"),
        (F.count_if((seconds > 0) & (seconds <= MAX_DURATION)) / F.nullif(F.count(seconds), F.lit(0))).alias(
            "__duration_ok"
        ),
    ]
    # the medians of all columns come from the same passes as the other figures
    medians = {"median_speed": speed, "median_duration": minutes, "median_observations_per_link": n, "median_link_length_m": "length_m"}
    row = quantile_row(selection, {name: (value, [0.5]) for name, value in medians.items()}, figures)
    row = row.withColumns({name: F.col(name)[0] for name in medians})
    total = network_links.agg(F.count("*").alias("n")).scalar()
    row = row.withColumns(
        {
            "coverage_percent": F.coalesce(F.col("n_links_rendered") * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)),
            "n_days": _day_count(days),
        }
    )
    factors = [1 - F.col("__sparse"), F.coalesce("__speed_ok", F.lit(0.0)), F.coalesce("__duration_ok", F.lit(0.0))]
    score = (factors[0] + factors[1] + factors[2]) / 3 * 100
    row = row.withColumns(
        {
            "sparse_links_percent": F.col("__sparse") * 100,
            "invalid_speeds_percent": (1 - factors[1]) * 100,
            "invalid_durations_percent": (1 - factors[2]) * 100,
            "data_quality_score": score,
            "coverage_quality": level_of(F.col("coverage_percent"), COVERAGE_LEVELS, "limited"),
            "temporal_coverage": level_of(F.col("n_days"), DAYS_LEVELS, "limited"),
        }
    )
    zero = ["mean_speed", "median_speed", "speed_std", "min_speed", "max_speed"]
    zero += ["mean_duration", "median_duration", "duration_std", "min_duration", "max_duration"]
    return (
        row.withColumn("quality_assessment", level_of(F.col("data_quality_score"), QUALITY_LEVELS))
        .na.fill(0.0, zero)
        .drop("__sparse", "__speed_ok", "__duration_ok")
    )


def _day_count(days: DataFrame | None) -> Column:
    if days is None:
        return F.lit(1).cast("bigint")
    distinct = days.select("date").where("date IS NOT NULL").distinct()
    return distinct.agg(F.count("*").alias("n")).scalar()


def filter_effect(selected: DataFrame, original: DataFrame) -> DataFrame:
    """One row: how much a filter removed, and a label for it."""
    kept = selected.agg(F.count("*").alias("filtered_records"))
    total = original.agg(F.count("*").alias("n")).scalar()
    row = kept.withColumn("original_records", total)
    cut = (F.col("original_records") - F.col("filtered_records")) * 100.0 / F.nullif(
        F.col("original_records"), F.lit(0)
    )
    # fixed values: effect limits
    label = (
        F.when(cut > 80, "very_high").when(cut > 60, "high").when(cut > 40, "moderate").when(cut > 20, "low")
    ).otherwise("minimal")
    return row.withColumns(
        {
            "filter_reduction_percent": F.coalesce(cut, F.lit(0.0)),
            "filter_effectiveness": F.when(cut.isNull(), "unknown").otherwise(label),
        }
    )


def kpi_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``metric, previous, current, change_percent, direction`` of the tracked figures of two KPI rows."""

    def long(df: DataFrame, name: str) -> DataFrame:
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in TRACKED])
        return wide.unpivot([], TRACKED, "metric", name)

    both = long(previous, "previous").join(long(current, "current"), "metric")
    change = F.when(F.col("previous") != 0, (F.col("current") - F.col("previous")) / F.col("previous") * 100)
    direction = F.when(change > 0, "up").when(change < 0, "down").otherwise("same")
    return both.withColumns({"change_percent": F.coalesce(change, F.lit(0.0)), "direction": direction})
