"""File formats, calendars and streams: the tables are written in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.operators import cleaning, spatial
from linkspark.sources import csv, holidays, network, sinks
from linkspark.streaming import rollup as stream
from linkspark.workload.registry import query, work_folder

RAW_HEADERS = {
    "data_id": "DataID", "name": "Name", "k": "SegmentID", "route_alternative": "RouteAlternative",
    "requested_time": "RequestedTime", "timestamp": "Timestamp", "day_in_week": "DayInWeek", "day_type": "DayType",
    "duration": "Duration (seconds)", "distance": "Distance (meters)", "speed": "Speed (km/h)",
    "valid_code": "Url", "polyline": "Polyline",
}


def _raw(v):
    return v.obs.select(*[F.col(c).cast("string").alias(h) for c, h in RAW_HEADERS.items()])


@query(
    "scan_observations",
    "obs",
    """SELECT data_id, name, k AS segment_id, route_alternative, requested_time, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
              coalesce(day_in_week, '') AS day_in_week, day_type, round(duration, 6) AS duration, round(distance, 6) AS distance, round(speed, 6) AS speed, valid_code AS url, polyline FROM obs""",
)
def scan_observations(v):
    folder = work_folder(v.spark)
    sinks.write_csv(_raw(v), f"{folder}/raw")
    rows = csv.scan(v.spark, f"{folder}/raw")
    return rows.drop("_row").withColumn("day_in_week", F.coalesce("day_in_week", F.lit("")))


@query(
    "scan_decimal_comma",
    "obs",
    "SELECT data_id, name, round(duration, 6) AS duration, round(speed, 6) AS speed FROM obs",
)
def scan_decimal_comma(v):
    folder = work_folder(v.spark)
    raw = _raw(v).withColumns({c: F.translate(c, ".", ",") for c in ("Duration (seconds)", "Distance (meters)", "Speed (km/h)")})
    raw.write.option("header", True).option("sep", ";").csv(f"{folder}/raw")
    rows = csv.scan(v.spark, f"{folder}/raw", ";", ",")
    return rows.select("data_id", "name", "duration", "speed")


def _lines(v):
    """Observation text lines with a semicolon and decimal commas."""
    amount = F.translate(F.format_string("%.2f", "duration"), ".", ",")
    return v.obs.select(F.concat_ws(";", "data_id", "name", amount, F.coalesce("day_in_week", F.lit(""))).alias("value"))


@query(
    "csv_dialect",
    "obs",
    """SELECT CAST(sum(CASE WHEN ',' = d THEN 1 WHEN ';' = d THEN 3 ELSE 0 END) AS BIGINT) AS n, d AS delimiter
       FROM obs, (VALUES (','), (';'), (chr(9)), ('|')) AS t(d) GROUP BY d""",
)
def csv_dialect(v):
    found = csv.dialect_evidence(_lines(v))
    names = [f"d{i}" for i in range(len(csv.DELIMITERS))]
    long = found.select(*[F.col(n).cast("bigint").alias(d) for n, d in zip(names, csv.DELIMITERS)])
    return long.unpivot([], [f"`{d}`" for d in csv.DELIMITERS], "delimiter", "n")


@query(
    "csv_charset",
    "obs",
    """SELECT count(*) AS lines, CAST(0 AS BIGINT) AS bad_utf8, CAST(0 AS BIGINT) AS bom, count(day_in_week) AS hebrew, count(day_in_week) AS greek,
              count(*) FILTER (WHERE day_in_week = 'א') AS undefined_1255, count(day_in_week) AS undefined_8859, count(*) FILTER (WHERE day_in_week = 'א') AS undefined_1252 FROM obs""",
)
def csv_charset(v):
    found = csv.charset_evidence(_lines(v))
    short = {"undefined_windows-1255": "undefined_1255", "undefined_ISO-8859-8": "undefined_8859", "undefined_windows-1252": "undefined_1252"}
    return found.withColumnsRenamed(short)


@query(
    "date_range",
    "obs",
    """SELECT CAST(min(CAST("timestamp" AS DATE)) AS VARCHAR) AS start_date, CAST(max(CAST("timestamp" AS DATE)) AS VARCHAR) AS end_date, count(*) AS n_rows FROM obs""",
)
def date_range(v):
    return csv.date_range(v.obs, now_year=2026)


@query(
    "load_network",
    "link_vertices link_lengths",
    """SELECT v.link_id, CAST(count(*) AS INT) AS n_vertices, round(any_value(length_m), 6) AS length_m
       FROM link_vertices v JOIN link_lengths l ON v.link_id = l.link_id GROUP BY v.link_id""",
)
def load_network(v):
    folder = work_folder(v.spark)
    table = v.lines.selectExpr("k AS id", "from_id AS FROM", "to_id AS to", "line")
    sinks.write_geojson_lines(table, f"{folder}/network")
    links = network.read_geojson_lines(v.spark, f"{folder}/network")
    return spatial.with_length(links).select("link_id", F.size("line").alias("n_vertices"), "length_m")


@query(
    "load_network_wkt",
    "link_vertices link_lengths",
    """SELECT v.link_id, CAST(count(*) AS INT) AS n_vertices, round(any_value(length_m), 6) AS length_m
       FROM link_vertices v JOIN link_lengths l ON v.link_id = l.link_id GROUP BY v.link_id""",
)
def load_network_wkt(v):
    folder = work_folder(v.spark)
    table = v.lines.selectExpr("k AS ID", "from_id AS From", "to_id AS To", "line")
    sinks.write_wkt_csv(table, f"{folder}/network")
    links = network.read_wkt_csv(v.spark, f"{folder}/network")
    return spatial.with_length(links).select("link_id", F.size("line").alias("n_vertices"), "length_m")


@query("holidays_text", "calendar", "SELECT CAST(date AS VARCHAR) AS date, CASE WHEN day(date) = 1 THEN 'Custom Holiday ' || date ELSE name END AS name FROM calendar")
def holidays_text(v):
    day = F.col("date").cast("string")
    lines = v.calendar.select(
        F.explode(
            F.array(
                F.lit("# comment"), F.lit(""), F.lit("no date here"),
                F.when(F.dayofmonth("date") == 1, day)
                .when(F.dayofmonth("date") == 15, F.concat_ws(" - ", day, "name"))
                .otherwise(F.concat_ws(", ", day, "name")),
            )
        ).alias("value")
    )
    return holidays.from_text_lines(lines)


@query("holidays_ics", "calendar", "SELECT CAST(date AS VARCHAR) AS date, CASE WHEN day(date) = 1 THEN 'Custom Holiday' ELSE name END AS name FROM calendar")
def holidays_ics(v):
    compact = F.date_format("date", "yyyyMMdd")
    start = (
        F.when(F.dayofmonth("date") == 1, F.concat(F.lit("DTSTART;VALUE=DATE:"), compact))
        .when(F.dayofmonth("date") == 15, F.concat(F.lit("DTSTART:"), compact, F.lit("T120000Z")))
        .otherwise(F.concat(F.lit("DTSTART:"), F.col("date").cast("string"), F.lit("T00:00:00")))
    )
    summary = F.when(F.dayofmonth("date") != 1, F.concat(F.lit("SUMMARY:"), "name"))
    folder = work_folder(v.spark)
    event = F.concat_ws("\n", F.lit("BEGIN:VEVENT"), start, summary, F.lit("END:VEVENT"))
    v.calendar.select(event.alias("value")).write.text(f"{folder}/ics")
    return holidays.read_ics(v.spark, f"{folder}/ics")


@query(
    "geojson_features",
    "link_vertices",
    """SELECT '{"type":"Feature","properties":{"link_id":"' || link_id || '","from_id":' || k || '},"geometry":{"type":"LineString","coordinates":['
              || string_agg('[' || x || ',' || y || ']', ',' ORDER BY seq) || ']}}' AS value FROM link_vertices GROUP BY link_id, k""",
)
def geojson_features(v):
    return sinks.geojson_features(v.lines.select("link_id", "from_id", "line"))


@query(
    "hourly_csv",
    "hourly",
    """SELECT link_id, CAST(date AS VARCHAR) AS date, CAST(hour_of_day AS VARCHAR) AS hour_of_day, daytype, CAST(n_valid AS VARCHAR) AS n_valid,
              coalesce(printf('%.4f', round(avg_duration_sec, 4)), '') AS avg_duration_sec FROM hourly""",
)
def hourly_csv(v):
    folder = work_folder(v.spark)
    sinks.write_hourly_csv(v.hourly, f"{folder}/hourly")
    text = v.spark.read.option("header", True).csv(f"{folder}/hourly")
    short = F.format_string("%.4f", F.round(F.col("avg_duration_sec").try_cast("double"), 4))
    shown = F.when(F.col("avg_duration_sec").isNotNull(), short).otherwise("")
    return text.select("link_id", "date", "hour_of_day", "daytype", "n_valid", shown.alias("avg_duration_sec"))


# --- streams ---


def _stream(v):
    schema = v.table("events").schema
    reader = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1)
    raw = reader.parquet(v.sf_dir)
    return raw.selectExpr(
        "event_id AS data_id", "concat('s_', user_id div 5 + 2, '-', user_id div 5 + 102) AS name",
        "CAST(ts AS TIMESTAMP) AS ts", "30 + 10 * value AS duration",
        "CAST(500 + 400 * ((user_id div 5 + 2) % 40) AS DOUBLE) / (30 + 10 * value) * CAST(3.6 AS DOUBLE) AS speed",
        "event_type <> 'error' AS is_valid", "event_type",
    )


@query(
    "stream_hourly",
    "obs",
    """SELECT name AS link_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) AS INT) AS hour_of_day, count(*) AS n_total,
              count(*) FILTER (WHERE is_valid) AS n_valid, round(avg(duration) FILTER (WHERE is_valid), 6) AS avg_duration_sec,
              round(stddev_samp(duration) FILTER (WHERE is_valid), 6) AS std_duration_sec, round(avg(speed) FILTER (WHERE is_valid), 6) AS avg_speed_kmh
       FROM obs GROUP BY name, date_trunc('hour', ts), CAST(ts AS DATE), hour(ts)
       HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM obs)) - INTERVAL 2 HOUR""",
)
def stream_hourly(v):
    folder = work_folder(v.spark)
    stream.run_available(stream.hourly(_stream(v)), f"{folder}/out", f"{folder}/checkpoint")
    return v.spark.read.parquet(f"{folder}/out")


@query("stream_dedup", "obs", "SELECT data_id, name, is_valid FROM obs")
def stream_dedup(v):
    folder = work_folder(v.spark)
    again = F.when(F.col("event_type") == "purchase", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = _stream(v).withColumn("delivery", F.explode(again)).drop("delivery")
    stream.run_available(stream.deduplicate(twice), f"{folder}/out", f"{folder}/checkpoint")
    return v.spark.read.parquet(f"{folder}/out").select("data_id", "name", "is_valid")


@query(
    "normalize_labels",
    "obs",
    """SELECT data_id, coalesce(CASE WHEN valid_code = 'view' THEN 'שבת' ELSE day_type END, '') AS day_type, coalesce(day_in_week, '') AS day_in_week FROM obs""",
)
def normalize_labels(v):
    from linkspark.plans.control import repair_labels

    damaged = v.obs.withColumn("day_type", F.when(F.col("valid_code") == "view", "־©־±־×").otherwise(F.col("day_type")))
    fixed = repair_labels(damaged)
    return cleaning.normalize_columns(fixed).select(
        "data_id", F.coalesce("day_type", F.lit("")).alias("day_type"), F.coalesce("day_in_week", F.lit("")).alias("day_in_week")
    )
