"""Cleaning, time, selection and rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.config import AggregationParams, CompletenessParams
from linkspark.functions import labels, temporal as time_fn, text
from linkspark.operators import cleaning, filters, network, rollup, temporal
from linkspark.plans import aggregation as plan
from linkspark.workload.registry import query

HOURLY_SQL = """
SELECT link_id, date, hour_of_day, daytype, n_total, n_valid, valid_hour, no_valid_hour,
       round(avg_duration_sec, 6) AS avg_duration_sec, round(std_duration_sec, 6) AS std_duration_sec,
       round(avg_static_duration_sec, 6) AS avg_static_duration_sec,
       round(std_static_duration_sec, 6) AS std_static_duration_sec,
       round(avg_distance_m, 6) AS avg_distance_m, round(avg_speed_kmh, 6) AS avg_speed_kmh
FROM {src}"""
WEEKLY_SQL = """
SELECT link_id, {group}, hour_of_day, round(avg_n_valid, 6) AS avg_n_valid, total_valid_n, total_not_valid,
       round(avg_dur, 6) AS avg_dur, round(std_dur, 6) AS std_dur, round(avg_static_dur, 6) AS avg_static_dur,
       round(std_static_dur, 6) AS std_static_dur, round(avg_dist, 6) AS avg_dist, round(avg_speed, 6) AS avg_speed,
       n_days
FROM {src}"""
BIG_HOURLY = """(
    SELECT name AS link_id, date, hour_of_day, daytype, count(*) AS n_total,
           CAST(count(*) FILTER (WHERE is_valid) AS BIGINT) AS n_valid,
           count(*) FILTER (WHERE is_valid) >= 1 AS valid_hour,
           CAST(count(*) FILTER (WHERE is_valid) < 1 AS INT) AS no_valid_hour,
           avg(duration) FILTER (WHERE is_valid) AS avg_duration_sec,
           stddev_samp(duration) FILTER (WHERE is_valid) AS std_duration_sec,
           avg(static_duration) FILTER (WHERE is_valid) AS avg_static_duration_sec,
           stddev_samp(static_duration) FILTER (WHERE is_valid) AS std_static_duration_sec,
           avg(distance) FILTER (WHERE is_valid) AS avg_distance_m,
           avg(speed) FILTER (WHERE is_valid) AS avg_speed_kmh
    FROM big GROUP BY name, date, hour_of_day, daytype)"""


def weekly_of(src: str, group: str) -> str:
    return f"""(
    SELECT link_id, {group}, hour_of_day, avg(n_valid) AS avg_n_valid,
           CAST(sum(n_valid) AS BIGINT) AS total_valid_n, CAST(sum(n_total - n_valid) AS BIGINT) AS total_not_valid,
           avg(avg_duration_sec) AS avg_dur, avg(std_duration_sec) AS std_dur,
           avg(avg_static_duration_sec) AS avg_static_dur, avg(std_static_duration_sec) AS std_static_dur,
           avg(avg_distance_m) AS avg_dist, avg(avg_speed_kmh) AS avg_speed, count(DISTINCT date) AS n_days
    FROM {src} WHERE valid_hour GROUP BY link_id, {group}, hour_of_day)"""


# --- rollups ---


@query("hourly_agg", "hourly", HOURLY_SQL.format(src="hourly"), dates="date")
def hourly_agg(v):
    return v.hourly


@query("hourly_agg_large", "big", HOURLY_SQL.format(src=BIG_HOURLY), dates="date")
def hourly_agg_large(v):
    return rollup.hourly_aggregation(v.big)


@query("weekly_profile", "weekly", WEEKLY_SQL.format(group="daytype", src="weekly"))
def weekly_profile(v):
    return v.weekly


@query("weekly_profile_large", "big", WEEKLY_SQL.format(group="daytype", src=weekly_of(BIG_HOURLY, "daytype")))
def weekly_profile_large(v):
    return rollup.weekly_profile(rollup.hourly_aggregation(v.big))


@query(
    "weekly_by_weekday",
    "hourly",
    WEEKLY_SQL.format(
        group="weekday_index",
        src=weekly_of(
            "(SELECT *, CAST(isodow(date) - 1 AS INT) AS weekday_index FROM hourly)", "weekday_index"
        ),
    ),
)
def weekly_by_weekday(v):
    return rollup.weekly_profile(v.hourly, "weekday_index")


@query(
    "weekly_pooled_std",
    "enh hourly",
    """
SELECT e.name AS link_id, e.daytype, e.hour_of_day, count(*) AS n_raw, round(stddev_samp(e.duration), 6) AS std_dur
FROM enh e JOIN hourly h ON e.name = h.link_id AND e.date = h.date AND e.hour_of_day = h.hour_of_day
     AND e.daytype = h.daytype AND h.valid_hour
WHERE e.is_valid GROUP BY e.name, e.daytype, e.hour_of_day""",
)
def weekly_pooled_std(v):
    return rollup.pooled_std(v.enhanced)


@query(
    "quality_by_link",
    "enh hourly",
    """
SELECT r.link_id, round(valid_rows * 100.0 / rows_, 2) AS percent_valid, hours_with_data, hours_valid,
       hours_with_data - hours_valid AS hours_dropped,
       round(hours_valid * 100.0 / hours_with_data, 2) AS percent_valid_hours, days_covered
FROM (SELECT name AS link_id, count(*) AS rows_, count(*) FILTER (WHERE is_valid) AS valid_rows FROM enh GROUP BY name) r
JOIN (SELECT link_id, count(*) AS hours_with_data, count(*) FILTER (WHERE valid_hour) AS hours_valid,
             count(DISTINCT date) AS days_covered FROM hourly GROUP BY link_id) h ON r.link_id = h.link_id""",
)
def quality_by_link(v):
    return rollup.quality_by_link(v.enhanced, v.hourly)


@query(
    "run_summary",
    "enh hourly weekly",
    """
SELECT r.*, round(r.valid_rows * 100.0 / r.raw_rows, 1) AS valid_percent, h.*, w.weekly_rows
FROM (SELECT count(*) AS raw_rows, count(*) FILTER (WHERE is_valid) AS valid_rows,
             count(*) FILTER (WHERE NOT is_valid) AS invalid_rows, count(DISTINCT name) AS distinct_links FROM enh) r,
     (SELECT count(*) AS hourly_rows, min(n_valid) AS n_valid_min, round(avg(n_valid), 1) AS n_valid_mean,
             round(median(n_valid), 1) AS n_valid_median, max(n_valid) AS n_valid_max FROM hourly) h,
     (SELECT count(*) AS weekly_rows FROM weekly) w""",
)
def run_summary(v):
    return rollup.run_summary(v.enhanced, v.hourly, v.weekly)


@query(
    "valid_hours_by_daytype",
    "hourly",
    "SELECT daytype, count(*) AS valid_hours FROM hourly WHERE valid_hour GROUP BY daytype",
)
def valid_hours_by_daytype(v):
    return rollup.valid_hours_by_daytype(v.hourly)


@query(
    "hourly_contract",
    "hourly",
    """
SELECT rule, violations FROM (
    SELECT 'hour_of_day outside 0-23' AS rule, count(*) FILTER (WHERE hour_of_day NOT BETWEEN 0 AND 23) AS violations FROM hourly
    UNION ALL SELECT 'n_valid above n_total', count(*) FILTER (WHERE n_valid > n_total) FROM hourly
    UNION ALL SELECT 'null link_id', count(*) FILTER (WHERE link_id IS NULL) FROM hourly
    UNION ALL SELECT 'null date', count(*) FILTER (WHERE date IS NULL) FROM hourly
    UNION ALL SELECT 'null hour_of_day', count(*) FILTER (WHERE hour_of_day IS NULL) FROM hourly
    UNION ALL SELECT 'null daytype', count(*) FILTER (WHERE daytype IS NULL) FROM hourly
    UNION ALL SELECT 'null n_total', count(*) FILTER (WHERE n_total IS NULL) FROM hourly
    UNION ALL SELECT 'null n_valid', count(*) FILTER (WHERE n_valid IS NULL) FROM hourly)""",
)
def hourly_contract(v):
    return rollup.hourly_contract(v.hourly)


@query(
    "preview",
    "hourly",
    HOURLY_SQL.format(src="hourly") + "\nORDER BY link_id NULLS LAST, date, hour_of_day, daytype LIMIT 100",
    dates="date",
)
def preview(v):
    return rollup.preview(v.hourly, ["link_id", "date", "hour_of_day", "daytype"])


RUN_SQL = """
, first_id AS (SELECT * FROM obs_dup QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY data_id, delivery) = 1),
  kept AS (SELECT * FROM first_id QUALIFY row_number() OVER (PARTITION BY name, "timestamp" ORDER BY data_id, delivery) = 1)
SELECT name AS link_id, CAST(CAST(k."timestamp" AS DATE) AS VARCHAR) AS date, CAST(hour(k."timestamp") AS INT) AS hour_of_day, daytype,
       count(*) AS n_total, CAST(count(*) FILTER (WHERE k.is_valid) AS BIGINT) AS n_valid,
       count(*) FILTER (WHERE k.is_valid) >= 2 AS valid_hour,
       CAST(count(*) FILTER (WHERE k.is_valid) < 2 AS INT) AS no_valid_hour,
       round(avg(k.duration) FILTER (WHERE k.is_valid), 6) AS avg_duration_sec,
       round(stddev_samp(k.duration) FILTER (WHERE k.is_valid), 6) AS std_duration_sec,
       round(avg(k.static_duration) FILTER (WHERE k.is_valid), 6) AS avg_static_duration_sec,
       round(stddev_samp(k.static_duration) FILTER (WHERE k.is_valid), 6) AS std_static_duration_sec,
       round(avg(k.distance) FILTER (WHERE k.is_valid), 6) AS avg_distance_m,
       round(avg(k.speed) FILTER (WHERE k.is_valid), 6) AS avg_speed_kmh
FROM kept k JOIN (SELECT data_id AS eid, daytype, weekday_index FROM enh) e ON e.eid = k.data_id
WHERE hour(k."timestamp") BETWEEN 6 AND 20 AND weekday_index < 5
GROUP BY ALL"""


@query("aggregation_run", "obs_dup enh", RUN_SQL)
def aggregation_run(v):
    params = AggregationParams(
        min_valid_per_hour=2, hours_include=tuple(range(6, 21)), weekday_include=(0, 1, 2, 3, 4)
    )
    prepared = plan.prepare(v.obs_dup, params, v.calendar, ["data_id", "delivery"])
    return plan.rollups(prepared, params)[0]


# --- cleaning ---


@query(
    "normalize_columns",
    "obs",
    "SELECT data_id, name, route_alternative, requested_time, round(duration, 6) AS duration, round(speed, 6) AS speed, day_in_week, my_extra_col FROM "
    "(SELECT *, k AS my_extra_col FROM obs)",
)
def normalize_columns(v):
    raw = v.obs.selectExpr(
        "data_id AS DataID", "name AS Name", "route_alternative AS RouteAlternative",
        "requested_time AS RequestedTime", "duration AS `Duration (seconds)`", "speed AS `Speed (km/h)`",
        "day_in_week AS DayInWeek", "k AS `MyExtra Col`",
    )
    return cleaning.normalize_columns(raw)


def _validity(v, columns):
    return v.obs.selectExpr("data_id", *columns)


@query("validity_bool", "obs", "SELECT data_id, coalesce(valid, false) AS is_valid FROM "
       "(SELECT data_id, CASE WHEN valid_code = 'view' THEN NULL ELSE is_valid END AS valid FROM obs)")
def validity_bool(v):
    raw = _validity(v, ["CASE WHEN valid_code = 'view' THEN NULL ELSE is_valid END AS valid"])
    return cleaning.resolve_validity(raw).select("data_id", "is_valid")


@query("validity_text", "obs", "SELECT data_id, valid_code IN ('click', 'view', 'purchase') AS is_valid FROM obs")
def validity_text(v):
    flag = "CASE valid_code WHEN 'click' THEN 'TRUE' WHEN 'view' THEN 'yes' WHEN 'purchase' THEN '1' WHEN 'error' THEN 'FALSE' END AS is_valid"
    return cleaning.resolve_validity(_validity(v, [flag]))


@query("validity_code", "obs", "SELECT data_id, valid_code IN ('click', 'view') AS is_valid FROM obs")
def validity_code(v):
    params = AggregationParams(valid_codes_ok=("click", "view"))
    return cleaning.resolve_validity(_validity(v, ["valid_code"]), params).select("data_id", "is_valid")


RANGES = AggregationParams(
    duration_range_sec=(60.0, 900.0), distance_range_m=(1000.0, 12000.0), speed_range_kmh=(5.0, 150.0)
)
NULLABLE = ["CASE WHEN valid_code = 'signup' THEN NULL ELSE duration END AS duration", "distance", "speed"]
NULLABLE_SQL = "(SELECT data_id, CASE WHEN valid_code = 'signup' THEN NULL ELSE duration END AS duration, distance, speed FROM obs)"


@query(
    "validity_ranges",
    "obs",
    f"""SELECT data_id, coalesce(duration BETWEEN 60 AND 900, false) AND distance BETWEEN 1000 AND 12000
        AND speed BETWEEN 5 AND 150 AS is_valid FROM {NULLABLE_SQL}""",
)
def validity_ranges(v):
    return cleaning.resolve_validity(_validity(v, NULLABLE), RANGES).select("data_id", "is_valid")


@query(
    "invalid_reasons",
    "obs",
    f"""SELECT 'duration_out_of_range' AS invalid_reason, count(*) FILTER (WHERE NOT coalesce(duration BETWEEN 60 AND 900, false)) AS count FROM {NULLABLE_SQL}
    UNION ALL SELECT 'distance_out_of_range', count(*) FILTER (WHERE distance NOT BETWEEN 1000 AND 12000) FROM {NULLABLE_SQL}
    UNION ALL SELECT 'speed_out_of_range', count(*) FILTER (WHERE speed NOT BETWEEN 5 AND 150) FROM {NULLABLE_SQL}""",
)
def invalid_reasons(v):
    return cleaning.invalid_reason_table(_validity(v, NULLABLE), RANGES)


@query(
    "invalid_codes",
    "obs",
    "SELECT valid_code AS invalid_reason, count(*) AS count FROM obs WHERE valid_code NOT IN ('click', 'view') GROUP BY 1",
)
def invalid_codes(v):
    return cleaning.invalid_reason_table(
        _validity(v, ["valid_code"]), AggregationParams(valid_codes_ok=("click", "view"))
    )


@query("range_check", "obs", "SELECT data_id, coalesce(speed BETWEEN 5 AND 150, false) AS in_range FROM obs")
def range_check(v):
    return v.obs.select("data_id", cleaning.in_range(v.obs, "speed", (5.0, 150.0)).alias("in_range"))


ORDER = ["data_id", "delivery"]


@query(
    "dedup_data_id",
    "obs_dup",
    """SELECT data_id, name, delivery FROM obs_dup
       QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY data_id, delivery) = 1""",
)
def dedup_data_id(v):
    return cleaning.dedup_data_id(v.obs_dup, ORDER).select("data_id", "name", "delivery")


@query(
    "dedup_link_ts",
    "obs_dup",
    """SELECT data_id, name, "timestamp", delivery FROM obs_dup
       QUALIFY row_number() OVER (PARTITION BY name, "timestamp" ORDER BY data_id, delivery) = 1""",
)
def dedup_link_ts(v):
    return cleaning.dedup_link_timestamp(v.obs_dup, ORDER).select("data_id", "name", "timestamp", "delivery")


@query(
    "dedup_obs",
    "obs_dup",
    """SELECT data_id, name AS link_id, "timestamp", polyline, delivery FROM obs_dup
       QUALIFY row_number() OVER (PARTITION BY name, "timestamp", polyline ORDER BY data_id, delivery) = 1""",
)
def dedup_obs(v):
    rows = v.obs_dup.withColumnRenamed("name", "link_id")
    return cleaning.dedup_observations(rows, ORDER).select("data_id", "link_id", "timestamp", "polyline", "delivery")


@query(
    "cleaning_stats",
    "obs_dup",
    """
, a AS (SELECT * FROM obs_dup QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY data_id, delivery) = 1),
  b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY name, "timestamp" ORDER BY data_id, delivery) = 1)
SELECT (SELECT count(*) FROM obs_dup) AS original_rows, (SELECT count(*) FILTER (WHERE is_valid) FROM obs_dup) AS valid_rows,
       (SELECT count(*) FROM obs_dup) - (SELECT count(*) FROM a) AS data_id_duplicates,
       (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS link_timestamp_duplicates,
       (SELECT count(*) FROM b) AS final_rows""",
)
def cleaning_stats(v):
    return cleaning.cleaning_stats(v.obs_dup, AggregationParams(), ORDER)


@query("fix_labels", "obs", "SELECT data_id, CASE WHEN valid_code = 'view' THEN 'יום ב' ELSE day_type END AS day_type FROM obs")
def fix_labels(v):
    damaged = F.when(F.col("valid_code") == "view", "־¹־µ־½ֲ ־²").otherwise(F.col("day_type"))
    return v.obs.select("data_id", labels.repair_label(damaged).alias("day_type"))


@query(
    "parse_link",
    "obs",
    """SELECT data_id, CASE WHEN valid_code = 'error' THEN NULL ELSE CAST(k AS VARCHAR) END AS from_id,
              CASE WHEN valid_code = 'error' THEN NULL ELSE CAST(k + 100 AS VARCHAR) END AS to_id,
              CASE WHEN valid_code = 'error' THEN NULL ELSE name END AS link_id FROM obs""",
)
def parse_link(v):
    raw = F.expr(
        "CASE valid_code WHEN 'error' THEN concat('link ', k) WHEN 'view' THEN concat('S-', k, '_', k + 100) "
        "WHEN 'click' THEN concat(' ', k, '-', k + 100, ' ') ELSE name END"
    )
    return v.obs.withColumn("raw", raw).select(
        "data_id",
        text.link_from(F.col("raw")).alias("from_id"),
        text.link_to(F.col("raw")).alias("to_id"),
        text.canonical_link(F.col("raw")).alias("link_id"),
    )


@query(
    "excel_serial",
    "obs",
    """SELECT data_id, TIMESTAMP '1899-12-30' + to_days(CAST(45292 + data_id % 366 AS INT)) + INTERVAL (CAST((data_id % 8) * 10800 AS INT)) SECOND AS ts,
              strftime(TIMESTAMP '2000-01-01' + INTERVAL (CAST((data_id % 8) * 10800 AS INT)) SECOND, '%H:%M:%S') AS requested_time FROM obs""",
)
def excel_serial(v):
    serial = F.expr("CAST(45292 + data_id % 366 AS DOUBLE) + CAST(data_id % 8 AS DOUBLE) / 8")
    return v.obs.select(
        "data_id",
        time_fn.excel_serial_to_timestamp(serial).alias("ts"),
        time_fn.day_fraction_to_time(F.expr("CAST(data_id % 8 AS DOUBLE) / 8")).alias("requested_time"),
    )


# --- time ---

TEXT_FORMATS = """CASE valid_code WHEN 'view' THEN date_format(timestamp, 'dd/MM/yyyy HH:mm')
    WHEN 'click' THEN date_format(timestamp, 'yyyy-MM-dd HH:mm:ss') WHEN 'purchase' THEN date_format(timestamp, 'yyyy-MM-dd HH:mm')
    WHEN 'signup' THEN date_format(timestamp, 'dd-MM-yyyy HH:mm:ss') ELSE 'not a time' END"""


@query(
    "parse_ts",
    "obs",
    """SELECT data_id, coalesce(try_strptime(t, '%d/%m/%Y %H:%M'), try_strptime(t, '%Y-%m-%d %H:%M:%S'),
              try_strptime(t, '%Y-%m-%d %H:%M'), try_strptime(t, '%d-%m-%Y %H:%M:%S')) AS "timestamp"
       FROM (SELECT data_id, CASE valid_code WHEN 'view' THEN strftime("timestamp", '%d/%m/%Y %H:%M')
             WHEN 'click' THEN strftime("timestamp", '%Y-%m-%d %H:%M:%S') WHEN 'purchase' THEN strftime("timestamp", '%Y-%m-%d %H:%M')
             WHEN 'signup' THEN strftime("timestamp", '%d-%m-%Y %H:%M:%S') ELSE 'not a time' END AS t FROM obs)""",
)
def parse_ts(v):
    raw = v.obs.select("data_id", F.expr(TEXT_FORMATS).alias("timestamp"))
    return temporal.parse_timestamps(raw, None)


@query(
    "parse_ts_chosen",
    "obs",
    """SELECT data_id, CASE WHEN valid_code = 'error' THEN NULL ELSE "timestamp" END AS "timestamp" FROM obs""",
)
def parse_ts_chosen(v):
    raw = v.obs.selectExpr(
        "data_id",
        "CASE WHEN valid_code = 'error' THEN date_format(timestamp, 'yyyy/MM/dd') "
        "ELSE date_format(timestamp, 'dd/MM/yyyy HH:mm') END AS timestamp",
    )
    fmt = temporal.choose_timestamp_format(raw, "timestamp", "yyyy-MM-dd HH:mm:ss")
    return temporal.parse_timestamps(raw, fmt)


@query(
    "parse_ts_iso",
    "obs",
    """SELECT data_id, CASE WHEN valid_code = 'error' THEN NULL WHEN valid_code = 'view' THEN CAST("timestamp" AS DATE)::TIMESTAMP
              ELSE "timestamp" END AS "timestamp" FROM obs""",
)
def parse_ts_iso(v):
    raw = F.expr(
        "CASE valid_code WHEN 'view' THEN date_format(timestamp, 'yyyy-MM-dd') "
        "WHEN 'click' THEN date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss\") "
        "WHEN 'purchase' THEN date_format(timestamp, 'dd/MM/yyyy HH:mm') WHEN 'error' THEN 'never' "
        "ELSE date_format(timestamp, 'yyyy-MM-dd HH:mm') END"
    )
    return v.obs.select("data_id", time_fn.parse_timestamp_iso_first(raw).alias("timestamp"))


@query(
    "localize_dst",
    "obs",
    """SELECT data_id, "timestamp" + INTERVAL (months) MONTH AS wall,
              "timestamp" + INTERVAL (months) MONTH - INTERVAL (CASE WHEN months = 6 THEN 3 ELSE 2 END) HOUR AS utc
       FROM (SELECT *, CASE WHEN valid_code = 'view' THEN 6 ELSE 0 END AS months FROM obs)""",
)
def localize_dst(v):
    wall = F.expr("timestamp + make_interval(0, CASE WHEN valid_code = 'view' THEN 6 ELSE 0 END)")
    return v.obs.select(
        "data_id", wall.alias("wall"), time_fn.local_to_utc(wall, "Asia/Jerusalem").alias("utc")
    )


@query(
    "derive_time",
    "timed",
    'SELECT data_id, "timestamp", date, hour_of_day, iso_week, weekday_index FROM timed',
    dates="date",
)
def derive_time(v):
    out = temporal.add_time_columns(v.obs)
    return out.select("data_id", "timestamp", "date", "hour_of_day", "iso_week", "weekday_index")


@query(
    "map_day_name",
    "timed",
    """SELECT data_id, CASE WHEN valid_code = 'view' THEN 6 ELSE weekday_index END AS weekday_index FROM timed""",
)
def map_day_name(v):
    label = F.expr("CASE WHEN valid_code = 'view' THEN concat(' יום', chr(160), 'א', chr(39), ' ') ELSE day_in_week END")
    rows = temporal.add_time_columns(v.obs.withColumn("day_in_week", label))
    return temporal.map_day_names(rows).select("data_id", "weekday_index")


@query(
    "map_daytype",
    "timed",
    """SELECT data_id, CASE WHEN valid_code = 'view' THEN NULL WHEN day_type = 'חג' THEN 'holiday' WHEN day_type = 'other' THEN 'special'
              WHEN day_type = 'workday' THEN 'weekday' ELSE 'weekend' END AS daytype FROM timed""",
)
def map_daytype(v):
    rows = temporal.add_time_columns(v.obs).withColumn(
        "day_type", F.expr("CASE WHEN valid_code = 'view' THEN NULL ELSE day_type END")
    )
    return temporal.map_daytypes(rows, {"special": ["other"]}).select("data_id", "daytype")


@query("holiday_calendar", "calendar", "SELECT date, name FROM calendar", dates="date")
def holiday_calendar(v):
    return v.calendar


@query(
    "classify_holidays",
    "enh",
    """SELECT data_id, is_holiday, holiday_name, CASE WHEN is_holiday THEN 'weekend' WHEN day_type = 'חג' THEN 'holiday'
              WHEN day_type = 'workday' THEN 'weekday' WHEN day_type = 'weekend' THEN 'weekend'
              WHEN weekday_index < 5 THEN 'weekday' ELSE 'weekend' END AS daytype FROM enh""",
)
def classify_holidays(v):
    rows = temporal.enhance(v.obs, AggregationParams(holidays_as="weekend"), v.calendar)
    return rows.select("data_id", "is_holiday", "holiday_name", "daytype")


@query("enhance", "enh", "SELECT data_id, date, hour_of_day, weekday_index, daytype, is_holiday, holiday_name FROM enh", dates="date")
def enhance(v):
    return v.enhanced.select(
        "data_id", "date", "hour_of_day", "weekday_index", "daytype", "is_holiday", "holiday_name"
    )


@query(
    "top_holidays",
    "enh",
    "SELECT holiday_name, count(*) AS n_rows FROM enh WHERE is_holiday GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_holidays(v):
    return temporal.top_holidays(v.enhanced)


@query("slot_floor", "ev", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS slot FROM ev")
def slot_floor(v):
    return v.table("events").select("event_id", time_fn.floor_to_interval(F.col("ts"), 15).alias("slot"))


@query(
    "day_period",
    "timed",
    """SELECT data_id, CASE WHEN hour_of_day < 6 THEN '00_06' WHEN hour_of_day < 11 THEN '06_11' WHEN hour_of_day < 15 THEN '11_15'
              WHEN hour_of_day < 20 THEN '15_20' ELSE '20_00' END AS period FROM timed""",
)
def day_period(v):
    return v.obs.select("data_id", time_fn.day_period(F.hour("timestamp")).alias("period"))


@query(
    "expected_slots",
    "links",
    """SELECT link_id, slot FROM links, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02 23:45:00', INTERVAL 15 MINUTE)) AS slot)""",
)
def expected_slots(v):
    from datetime import date

    from linkspark.operators import control

    return control.expected_slots(v.links, CompletenessParams(date(2024, 1, 1), date(2024, 1, 2), 15))


# --- selection ---


def _ids(df):
    return df.select("data_id")


@query("f_date", "enh", "SELECT data_id FROM enh WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def f_date(v):
    return _ids(filters.by_date_range(v.enhanced, "2024-01-05", "2024-01-20"))


@query("f_weekday", "enh", "SELECT data_id FROM enh WHERE weekday_index IN (0, 6)")
def f_weekday(v):
    return _ids(filters.by_weekday(v.enhanced, [0, 6, 9]))


@query("f_hour", "enh", "SELECT data_id FROM enh WHERE hour_of_day IN (7, 8, 17)")
def f_hour(v):
    return _ids(filters.by_hour(v.enhanced, [7, 8, 17, 24]))


@query(
    "f_links",
    "enh",
    "SELECT data_id FROM enh WHERE name IN ('s_3-103', 's_4-104', 's_5-105') AND name <> 's_4-104'",
)
def f_links(v):
    return _ids(filters.by_links(v.enhanced, "s_3-103, s_4-104,s_5-105", ["s_4-104"]))


@query("f_preset", "enh", "SELECT data_id FROM enh WHERE daytype = 'weekend'")
def f_preset(v):
    return _ids(filters.by_preset(v.enhanced, weekend_only=True))


@query(
    "f_chain",
    "enh",
    """SELECT data_id FROM enh WHERE date >= DATE '2024-01-05' AND weekday_index IN (0, 1, 2) AND hour_of_day BETWEEN 6 AND 18
       AND name <> 's_4-104' AND daytype = 'weekday'""",
)
def f_chain(v):
    params = AggregationParams(
        start_date="2024-01-05", weekday_include=(0, 1, 2), hours_include=tuple(range(6, 19)),
        blacklist_links="s_4-104", weekday_only=True,
    )
    return _ids(filters.select_observations(v.enhanced, params))


@query(
    "f_report_date",
    "obs",
    """SELECT data_id FROM obs WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'""",
)
def f_report_date(v):
    return _ids(filters.by_report_dates(v.obs, start_date="2024-01-03", end_date="2024-01-09"))


@query(
    "f_map_time",
    "results",
    "SELECT link_id, date, hour, daytype FROM results WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND hour BETWEEN 6 AND 9",
    dates="date",
)
def f_map_time(v):
    out = filters.by_map_time(v.results, ("2024-01-05", "2024-01-12"), (6, 9))
    return out.select("link_id", "date", "hour", "daytype")


@query(
    "f_attr",
    "results",
    "SELECT link_id, date, hour, daytype FROM results WHERE avg_speed_kmh > 40 AND avg_duration_sec < 500 AND n_valid BETWEEN 1 AND 3",
    dates="date",
)
def f_attr(v):
    rules = {
        "avg_speed_kmh": {"operator": "above", "value": 40},
        "avg_duration_sec": {"operator": "below", "value": 500},
        "n_valid": {"operator": "between", "value": (1, 3)},
        "unknown": {"operator": "above", "value": 1},
    }
    return filters.by_attributes(v.results, rules).select("link_id", "date", "hour", "daytype")


@query(
    "f_text",
    "results",
    "SELECT link_id, date, hour, daytype FROM results WHERE link_id LIKE '%\\_1%' ESCAPE '\\' OR link_id LIKE '%-120%'",
    dates="date",
)
def f_text(v):
    return filters.by_text(v.results, "link_id", "S_1", "-120\n").select("link_id", "date", "hour", "daytype")


@query("f_sparse", "results", "SELECT link_id, date, hour, daytype, n_valid FROM results WHERE n_valid >= 2", dates="date")
def f_sparse(v):
    return filters.drop_sparse(v.results, 2).select("link_id", "date", "hour", "daytype", "n_valid")


@query(
    "flagged",
    "results",
    """SELECT issue, count(*) AS n_rows, round(sum(avg_duration_sec), 4) AS total_duration FROM (
        SELECT *, unnest(list_filter([
            CASE WHEN avg_speed_kmh <= 0 THEN 'non_positive_speeds' END,
            CASE WHEN avg_speed_kmh > 120 OR (avg_speed_kmh > 0 AND avg_speed_kmh < 5) THEN 'extreme_speeds' END,
            CASE WHEN avg_duration_sec <= 0 THEN 'non_positive_durations' END,
            CASE WHEN avg_duration_sec > 3600 OR (avg_duration_sec > 0 AND avg_duration_sec < 30) THEN 'extreme_durations' END,
            CASE WHEN n_valid < 3 THEN 'sparse_observations' END], lambda x: x IS NOT NULL)) AS issue FROM results)
       GROUP BY issue""",
    digits=4,
)
def flagged(v):
    flagged_rows = filters.flagged_records(v.results)
    return flagged_rows.groupBy("issue").agg(
        F.count("*").alias("n_rows"), F.sum("avg_duration_sec").alias("total_duration")
    )


# --- sets ---


@query(
    "union_obs",
    "obs",
    """SELECT data_id, name, polyline FROM obs WHERE is_valid
       UNION ALL SELECT data_id, name, NULL FROM obs WHERE NOT is_valid""",
)
def union_obs(v):
    good = v.obs.where("is_valid").select("data_id", "name", "polyline")
    return network.union_all(good, v.obs.where("NOT is_valid").select("name", "data_id"))


@query("keys_intersect", "links results", "SELECT link_id FROM links INTERSECT SELECT link_id FROM results")
def keys_intersect(v):
    return network.keys_in_both(v.links, v.results)


@query(
    "keys_except",
    "links results",
    """SELECT link_id, 'network' AS missing_in FROM (SELECT link_id FROM results EXCEPT SELECT link_id FROM links)
       UNION ALL SELECT link_id, 'results' FROM (SELECT link_id FROM links EXCEPT SELECT link_id FROM results)""",
)
def keys_except(v):
    return network.keys_in_one(v.links, v.results)


@query(
    "dup_rows",
    "obs_dup",
    """SELECT count(*) AS total_records, (SELECT count(*) FROM (SELECT DISTINCT name, "timestamp", route_alternative, duration FROM obs_dup)) AS distinct_records,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT name, "timestamp", route_alternative, duration FROM obs_dup)) AS duplicate_records FROM obs_dup""",
)
def dup_rows(v):
    return network.duplicate_rows(v.obs_dup.select("name", "timestamp", "route_alternative", "duration"))
