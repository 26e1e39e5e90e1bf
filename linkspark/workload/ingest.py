"""Reading files whose peculiarities show late, and the text of every kind of output file."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.operators import cleaning, filters, rollup, temporal
from linkspark.sources import csv, sinks
from linkspark.workload.files import _raw
from linkspark.workload.registry import query, work_folder


@query("scan_text_ids", "obs", "SELECT 'a-' || data_id AS data_id, name FROM obs")
def scan_text_ids(v):
    folder = work_folder(v.spark)
    sinks.write_csv(_raw(v).withColumn("DataID", F.concat(F.lit("a-"), "DataID")), f"{folder}/raw")
    return cleaning.dedup_data_id(csv.read_observations(v.spark, f"{folder}/raw"), ["_row"]).select("data_id", "name")


@query("scan_big_ids", "obs", "SELECT 9007199254740992 + data_id AS data_id, name FROM obs")
def scan_big_ids(v):
    folder = work_folder(v.spark)
    big = (F.lit(9007199254740992) + F.col("DataID").cast("bigint")).cast("string")
    sinks.write_csv(_raw(v).withColumn("DataID", big), f"{folder}/raw")
    return cleaning.dedup_data_id(csv.read_observations(v.spark, f"{folder}/raw"), ["_row"]).select("data_id", "name")


@query("scan_late_hebrew", "obs", "SELECT data_id, coalesce(day_in_week, '') AS day_in_week, day_type FROM obs")
def scan_late_hebrew(v):
    # lines without Hebrew letters come first in every file; only those decide nothing
    v.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    folder = work_folder(v.spark)
    hebrew = F.concat_ws("", "DayInWeek", "DayType").rlike(r"\p{InHebrew}")
    late = _raw(v).repartition(4, "Name").sortWithinPartitions(hebrew, "DataID")
    late.write.option("header", True).option("encoding", "windows-1255").csv(f"{folder}/raw")
    rows = csv.read_observations(v.spark, f"{folder}/raw")
    return rows.select("data_id", F.coalesce("day_in_week", F.lit("")).alias("day_in_week"), "day_type")


@query(
    "scan_late_decimal",
    "obs",
    "SELECT data_id, floor(duration) + CASE WHEN data_id % 3 = 0 THEN 0.0 ELSE 0.5 END AS duration FROM obs",
)
def scan_late_decimal(v):
    folder = work_folder(v.spark)
    whole = F.floor(F.col("Duration (seconds)").cast("double")).cast("string")
    late = F.col("DataID").cast("bigint") % 3 != 0
    numbers = {c: F.floor(F.col(c).cast("double")).cast("string") for c in ("Distance (meters)", "Speed (km/h)")}
    raw = _raw(v).withColumns(numbers | {"Duration (seconds)": F.when(late, F.concat(whole, F.lit(",5"))).otherwise(whole)})
    placed = raw.repartition(4, "Name").sortWithinPartitions(late, "DataID")
    placed.write.option("header", True).option("sep", ";").csv(f"{folder}/raw")
    return csv.read_observations(v.spark, f"{folder}/raw").select("data_id", "duration")


@query(
    "parse_ts_iso_t",
    "obs",
    """SELECT data_id, "timestamp" + CASE WHEN data_id % 2 = 0 THEN INTERVAL 0 SECOND ELSE INTERVAL 250 MILLISECOND END AS "timestamp" FROM obs""",
)
def parse_ts_iso_t(v):
    text = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("data_id") % 2 == 0, "").otherwise(".250"))
    raw = v.obs.select("data_id", text.alias("timestamp"))
    return temporal.parse_timestamps(raw, temporal.choose_timestamp_format(raw, "timestamp", "yyyy-MM-dd HH:mm:ss"))


@query(
    "parse_ts_offset",
    "obs",
    """SELECT data_id, "timestamp" - CASE WHEN data_id % 3 = 0 THEN INTERVAL 0 MINUTE WHEN data_id % 3 = 1 THEN INTERVAL 330 MINUTE
              ELSE INTERVAL (-180) MINUTE END AS "timestamp" FROM obs""",
)
def parse_ts_offset(v):
    offset = F.when(F.col("data_id") % 3 == 0, "Z").when(F.col("data_id") % 3 == 1, "+05:30").otherwise("-0300")
    raw = v.obs.select("data_id", F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), offset).alias("timestamp"))
    fmt = temporal.choose_timestamp_format(raw, "timestamp", "yyyy-MM-dd HH:mm:ss")
    return temporal.parse_timestamps(raw, fmt, timezone="UTC")


@query("parse_ts_mixed", "obs", """SELECT data_id, "timestamp", CAST(NULL AS VARCHAR) AS unresolved FROM obs WHERE data_id % 50 <> 7
           UNION ALL SELECT data_id, NULL, 'no time ' || data_id FROM obs WHERE data_id % 50 = 7""")
def parse_ts_mixed(v):
    # most rows in one layout, others in ISO text, and some of one link in none; the deduplication keeps every row
    lost, key = F.col("data_id") % 50 == 7, F.col("data_id").cast("string")
    iso, plain = (F.date_format("timestamp", fmt) for fmt in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"))
    text = F.when(lost, F.concat(F.lit("no time "), key)).when(F.col("data_id") % 5 < 2, iso).otherwise(plain)
    raw = v.obs.select("data_id", F.when(lost, "one link").otherwise(key).alias("name"), text.alias("timestamp"))
    rows = temporal.resolve_timestamps(raw, "yyyy-MM-dd HH:mm:ss", timezone="UTC")
    return cleaning.dedup_link_timestamp(rows, ["data_id"]).select("data_id", "timestamp", F.col("_unresolved").alias("unresolved"))


@query(
    "parse_ts_files",
    "obs",
    """SELECT data_id, "timestamp" FROM obs""",
)
def parse_ts_files(v):
    # files of different layouts: what both layouts can read is settled by the file
    file = F.when(F.col("data_id") % 2 == 0, "a").otherwise("b")
    month_first = F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss")
    text = F.when(file == "a", month_first).otherwise(F.date_format("timestamp", "dd/MM/yyyy HH:mm:ss"))
    raw = v.obs.select("data_id", file.alias("_file"), text.alias("timestamp"))
    return temporal.resolve_timestamps(raw, "yyyy-MM-dd HH:mm:ss", by="_file").select("data_id", "timestamp")


@query(
    "f_links_long",
    "enh",
    "SELECT name, data_id FROM enh WHERE name IN (SELECT 's_' || i || '-' || (i + 100) FROM range(0, 3000, 2) AS r(i))",
)
def f_links_long(v):
    names = [f"s_{i}-{i + 100}" for i in range(0, 3000, 2)]
    return filters.by_links(v.enhanced.select("data_id", "name"), names)


def _text(v, folder):
    return v.spark.read.option("header", True).option("nullValue", "").csv(folder)


def _shown(df):
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


@query(
    "hourly_csv_text",
    "hourly",
    """SELECT link_id, CAST(date AS VARCHAR) AS date, CAST(hour_of_day AS VARCHAR) AS hour_of_day, coalesce(printf('%.6f', avg_dist), '') AS avg_distance_m
       FROM (SELECT link_id, date, hour_of_day, avg_distance_m AS avg_dist FROM hourly)""",
)
def hourly_csv_text(v):
    folder = work_folder(v.spark)
    sinks.write_hourly_csv(v.hourly, f"{folder}/hourly")
    return _shown(_text(v, f"{folder}/hourly").select("link_id", "date", "hour_of_day", "avg_distance_m"))


@query(
    "weekly_csv",
    "weekly",
    """SELECT link_id, daytype, CAST(hour_of_day AS VARCHAR) AS hour_of_day, CAST(n_days AS VARCHAR) AS n_days, round(avg_dur, 6) AS avg_dur FROM weekly""",
)
def weekly_csv(v):
    folder = work_folder(v.spark)
    sinks.write_weekly_csv(v.weekly, f"{folder}/weekly")
    rows = _text(v, f"{folder}/weekly")
    return rows.select("link_id", "daytype", "hour_of_day", "n_days", F.col("avg_dur").cast("double").alias("avg_dur"))


@query(
    "extract_csv",
    "obs",
    """SELECT CAST(data_id AS VARCHAR) AS data_id, name, printf('%g', distance * 1.0) AS distance, printf('%g', distance * 1000.0) AS far,
              printf('%g', distance / 67108864.0) AS near FROM obs""",
)
def extract_csv(v):
    folder = work_folder(v.spark)
    rows = v.obs.selectExpr("data_id", "name", "timestamp", "distance", "distance * double(1000) AS far", "distance / double(67108864) AS near")
    sinks.write_extract_csv(rows, f"{folder}/extract")
    text = _text(v, f"{folder}/extract")
    return text.withColumnRenamed(text.columns[0], "data_id").select("data_id", "name", "distance", "far", "near")


@query(
    "quality_csv",
    "enh hourly",
    """SELECT r.link_id, CAST(hours_with_data AS VARCHAR) AS hours_with_data, CAST(hours_valid AS VARCHAR) AS hours_valid
       FROM (SELECT DISTINCT name AS link_id FROM enh) r
       JOIN (SELECT link_id, count(*) AS hours_with_data, count(*) FILTER (WHERE valid_hour) AS hours_valid FROM hourly GROUP BY link_id) h
       ON r.link_id = h.link_id""",
)
def quality_csv(v):
    folder = work_folder(v.spark)
    sinks.write_csv(rollup.quality_by_link(v.enhanced, v.hourly), f"{folder}/quality", ["link_id"])
    return _text(v, f"{folder}/quality").select("link_id", "hours_with_data", "hours_valid")


@query("sidecar", "hourly", "SELECT count(*) AS record_count, 'hourly' AS layer FROM hourly")
def sidecar(v):
    folder = work_folder(v.spark)
    sinks.write_sidecar(v.hourly, f"{folder}/sidecar", layer="hourly")
    return v.spark.read.json(f"{folder}/sidecar").select("record_count", "layer")


@query("preview_raw", "obs", "SELECT data_id, name FROM obs ORDER BY data_id LIMIT 100")
def preview_raw(v):
    return rollup.preview(v.obs, ["data_id"]).select("data_id", "name")
