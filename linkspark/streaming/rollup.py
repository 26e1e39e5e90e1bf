"""Streaming forms of the deduplication and the hourly rollup, and the deviation from a stored profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicate(stream: DataFrame, event_time: str = "ts", delay: str = "2 hours") -> DataFrame:
    """First arrival per ``data_id``; state is kept for the watermark delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["data_id"])


def hourly(stream: DataFrame, event_time: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Hourly counts and metrics on event time; an hour is final once the watermark has passed its end.

    The watermark must not be set before: pass the raw stream, or one from :func:`deduplicate` with
    ``delay=None``.
    """
    if delay is not None:
        stream = stream.withWatermark(event_time, delay)
    valid = F.col("is_valid")
    grouped = stream.groupBy(F.window(event_time, "1 hour"), F.col("name").alias("link_id")).agg(
        F.count("is_valid").alias("n_total"),
        F.count_if(valid).alias("n_valid"),
        F.avg(F.when(valid, F.col("duration"))).alias("avg_duration_sec"),
        F.stddev_samp(F.when(valid, F.col("duration"))).alias("std_duration_sec"),
        F.avg(F.when(valid, F.col("speed"))).alias("avg_speed_kmh"),
    )
    start = F.col("window.start")
    return grouped.select(
        "link_id",
        F.to_date(start).alias("date"),
        F.hour(start).alias("hour_of_day"),
        "n_total",
        "n_valid",
        "avg_duration_sec",
        "std_duration_sec",
        "avg_speed_kmh",
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there into Parquet, then stop; restarts go on from the checkpoint."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def deviations(hourly_rows: DataFrame, profile: DataFrame, k: float = 2.0) -> DataFrame:
    """Hours whose mean duration lies more than ``k`` profile deviations from the profile.

    Works on a stream of hours too: the profile is the static side of the join.
    """
    reference = profile.select("link_id", "daytype", "hour_of_day", "avg_dur", "std_dur")
    joined = hourly_rows.join(reference, ["link_id", "daytype", "hour_of_day"])
    gap = F.col("avg_duration_sec") - F.col("avg_dur")
    return joined.where(F.abs(gap) > k * F.col("std_dur")).withColumn("deviation_sec", gap)
