"""Network joins, map rollups, classes, quality and key-figure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.operators import classify, filters, kpi, network, quality, rollup
from linkspark.operators.quantiles import exact_quantiles
from linkspark.plans import maps
from linkspark.streaming import rollup as stream
from linkspark.workload.registry import query

# --- joins ---


@query(
    "net_left",
    "links results",
    """SELECT l.link_id, l.from_id, l.to_id, coalesce(CAST(r.date AS VARCHAR), '') AS date, coalesce(r.hour, -1) AS hour, coalesce(r.daytype, '') AS daytype,
              round(r.avg_duration_sec, 6) AS avg_duration_sec FROM links l LEFT JOIN results r ON l.link_id = r.link_id""",
)
def net_left(v):
    joined = network.join_network(v.links, v.results)
    return joined.select(
        "link_id", "from_id", "to_id",
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"),
        F.coalesce("hour", F.lit(-1)).alias("hour"),
        F.coalesce("daytype", F.lit("")).alias("daytype"),
        "avg_duration_sec",
    )


@query("missing_links", "links results", "SELECT DISTINCT link_id FROM results WHERE link_id NOT IN (SELECT link_id FROM links)")
def missing_links(v):
    return network.missing_in_network(v.links, v.results)


MATCH_SQL = """
SELECT network_keys, result_keys, matched, result_keys - matched AS missing_in_network, network_keys - matched AS missing_in_results,
       round(matched * 100.0 / network_keys, 6) AS join_success_rate
FROM (SELECT (SELECT count(*) FROM links) AS network_keys, (SELECT count(DISTINCT link_id) FROM results) AS result_keys,
             (SELECT count(DISTINCT link_id) FROM results WHERE link_id IN (SELECT link_id FROM links)) AS matched)"""


@query("match_counts", "links results", MATCH_SQL)
def match_counts(v):
    return network.match_counts(v.links, v.results)


AUDIT_SQL = f"""
SELECT *, concat_ws('; ',
    CASE WHEN join_success_rate < 50 THEN 'Low join success rate - verify link_id format matches s_From-To pattern'
         WHEN join_success_rate < 80 THEN 'Moderate join success rate - review missing links for data completeness' END,
    CASE WHEN missing_in_network > 0 THEN 'Consider updating shapefile - ' || missing_in_network || ' result links have no geometry' END,
    CASE WHEN missing_in_results > 0 THEN 'Consider data collection - ' || missing_in_results || ' shapefile links have no results' END,
    CASE WHEN duplicate_records > 0 THEN 'Remove ' || duplicate_records || ' duplicate records before analysis' END) AS recommendations
FROM ({MATCH_SQL}) m,
     (SELECT count(*) AS network_features, CAST(count(*) - count(DISTINCT link_id) AS BIGINT) AS network_duplicates FROM links) n,
     (SELECT count(*) AS result_records, count(*) FILTER (WHERE link_id IS NULL) AS null_link_ids FROM results) r,
     (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_records, count(*) AS duplicate_combinations, count(DISTINCT link_id) AS links_with_duplicates
      FROM (SELECT link_id, date, hour, count(*) AS n FROM results GROUP BY link_id, date, hour HAVING count(*) > 1)) d"""


@query("join_audit", "links results", AUDIT_SQL)
def join_audit(v):
    return network.join_audit(v.links, v.results)


@query(
    "dup_audit",
    "obs_dup",
    """SELECT CAST(sum(n) AS BIGINT) AS duplicate_records, count(*) AS duplicate_combinations, count(DISTINCT name) AS links_with_duplicates
       FROM (SELECT name, CAST("timestamp" AS DATE), hour("timestamp"), count(*) AS n FROM obs_dup GROUP BY ALL HAVING count(*) > 1)""",
)
def dup_audit(v):
    rows = v.obs_dup.select(
        F.col("name").alias("link_id"), F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour")
    )
    return network.duplicate_keys(rows)


@query(
    "map_hour",
    "links results",
    """SELECT l.link_id, r.daytype, r.n_valid, round(avg_duration_sec / 60, 6) AS duration_min,
              CASE WHEN avg_duration_sec / 60 < 3 THEN 'green' WHEN avg_duration_sec / 60 < 5 THEN 'orange' ELSE 'red' END AS color
       FROM links l JOIN results r ON l.link_id = r.link_id WHERE date = DATE '2024-01-10' AND hour = 12""",
)
def map_hour(v):
    shown = maps.hour_map(v.links, v.hourly, "2024-01-10", 12)
    return shown.select("link_id", "daytype", "n_valid", "duration_min", "color")


@query(
    "map_week",
    "links weekly",
    """SELECT l.link_id, w.daytype, round(avg_speed, 6) AS avg_speed_kmh,
              CASE WHEN avg_speed < 30 THEN 'red' WHEN avg_speed < 50 THEN 'orange' ELSE 'green' END AS color
       FROM links l JOIN weekly w ON l.link_id = w.link_id WHERE hour_of_day = 8 AND daytype = 'weekday'""",
)
def map_week(v):
    shown = maps.week_map(v.links, v.weekly, 8, "weekday", "speed")
    return shown.select("link_id", "daytype", "avg_speed_kmh", "color")


@query(
    "map_prepare",
    "link_vertices results",
    """SELECT l.link_id, CAST(r.date AS VARCHAR) AS date, r.hour, r.daytype, round(r.avg_speed_kmh, 6) AS avg_speed_kmh
       FROM (SELECT link_id FROM link_vertices GROUP BY link_id HAVING max(x) >= 4500 AND min(x) <= 10500) l
       JOIN results r ON l.link_id = r.link_id
       WHERE r.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND r.hour BETWEEN 6 AND 18 AND r.avg_speed_kmh > 20""",
)
def map_prepare(v):
    box = [(4500, -1000), (10500, -1000), (10500, 1000), (4500, 1000)]
    rows = maps.prepare(
        v.lines, v.hourly, ("2024-01-05", "2024-01-20"), (6, 18), {"avg_speed_kmh": {"operator": "above", "value": 20}}, box
    )
    return rows.select("link_id", "date", "hour", "daytype", "avg_speed_kmh")


# --- map rollups ---

WEEK_SQL = """SELECT link_id, hour, CAST(sum(n_valid) AS BIGINT) AS n_valid, round({agg}(avg_duration_sec), 6) AS avg_duration_sec,
                     round({agg}(avg_speed_kmh), 6) AS avg_speed_kmh FROM results GROUP BY link_id, hour"""


def _map_weekly(v, method, weighted=False):
    out = rollup.map_weekly(v.results, method, weighted)
    return out.select("link_id", "hour", "n_valid", "avg_duration_sec", "avg_speed_kmh")


@query("map_weekly_mean", "results", WEEK_SQL.format(agg="avg"))
def map_weekly_mean(v):
    return _map_weekly(v, "mean")


@query("map_weekly_median", "results", WEEK_SQL.format(agg="median"))
def map_weekly_median(v):
    return _map_weekly(v, "median")


@query(
    "map_weekly_weighted",
    "results",
    """SELECT link_id, hour, CAST(sum(n_valid) AS BIGINT) AS n_valid,
              round(sum(avg_duration_sec * n_valid) / nullif(sum(n_valid) FILTER (WHERE avg_duration_sec IS NOT NULL), 0), 6) AS avg_duration_sec,
              round(sum(avg_speed_kmh * n_valid) / nullif(sum(n_valid) FILTER (WHERE avg_speed_kmh IS NOT NULL), 0), 6) AS avg_speed_kmh
       FROM results GROUP BY link_id, hour""",
)
def map_weekly_weighted(v):
    return _map_weekly(v, "mean", True)


@query(
    "date_span",
    "results",
    """SELECT CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date, count(DISTINCT date) AS n_days,
              min(date) || ' to ' || max(date) AS date_range_str FROM results""",
)
def date_span(v):
    return rollup.date_span(v.results)


@query(
    "link_detail",
    "results",
    """SELECT link_id, CAST(sum(n_valid) AS BIGINT) AS total_observations, CAST(count(DISTINCT date) AS INT) AS unique_dates, CAST(count(DISTINCT hour) AS INT) AS unique_hours,
              string_agg(DISTINCT CAST(date AS VARCHAR), ',' ORDER BY CAST(date AS VARCHAR)) AS date_coverage,
              list_aggregate(list_sort(list_distinct(list(hour))), 'string_agg', ',') AS hour_coverage,
              CASE WHEN sum(n_valid) = 0 THEN 'no_data' WHEN sum(n_valid) < 10 THEN 'sparse' WHEN count(*) < 5 THEN 'limited'
                   WHEN sum(n_valid) < 50 THEN 'moderate' ELSE 'good' END AS data_quality
       FROM results GROUP BY link_id""",
)
def link_detail(v):
    detail = rollup.link_detail(v.results)
    return detail.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("date_coverage", "hour_coverage")})


@query(
    "hour_pattern",
    "results",
    """SELECT link_id, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value,
              round(stddev_samp(value), 6) AS std_value, arg_max(hour, value ORDER BY hour) AS peak_hour, arg_min(hour, value ORDER BY hour) AS off_peak_hour,
              round(CASE WHEN avg(value) > 0 THEN stddev_samp(value) / avg(value) ELSE 0 END, 6) AS variation_coefficient,
              count(*) AS n_hours
       FROM (SELECT link_id, hour, median(avg_duration_sec) AS value FROM results GROUP BY link_id, hour) GROUP BY link_id""",
)
def hour_pattern(v):
    pattern = rollup.hour_pattern(v.results, "avg_duration_sec")
    return pattern.withColumn("n_hours", F.size("hourly_values").cast("bigint")).drop("hourly_values")


@query(
    "agg_check",
    "results",
    """
, week AS (SELECT link_id, hour, median(avg_duration_sec) AS d, median(avg_speed_kmh) AS s FROM results GROUP BY link_id, hour)
SELECT (SELECT count(*) FROM results) AS original_records, count(*) AS aggregated_records,
       (SELECT count(DISTINCT link_id) FROM results) AS links_processed, count(DISTINCT link_id) AS links_in_result, CAST(0 AS BIGINT) AS lost_links,
       count(*) FILTER (WHERE d > 3600) AS extreme_durations, count(*) FILTER (WHERE s > 200) AS extreme_speeds,
       round(count(*) / (SELECT count(*) FROM results), 6) AS compression_ratio, count(*) / (SELECT count(*) FROM results) > 0.8 AS low_compression,
       false AS data_loss FROM week""",
)
def agg_check(v):
    return rollup.aggregation_check(v.results, rollup.map_weekly(v.results))


@query(
    "rollup_completeness",
    "results",
    """SELECT count(*) AS records, count(*) FILTER (WHERE avg_duration_sec IS NULL) AS missing_duration, count(*) FILTER (WHERE avg_speed_kmh IS NULL) AS missing_speed,
              CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date, CAST(count(DISTINCT hour) AS INT) AS hours_covered, min(hour) AS min_hour, max(hour) AS max_hour,
              round(count(*) FILTER (WHERE avg_duration_sec IS NULL) * 100.0 / count(*), 6) AS missing_duration_percent,
              round(count(*) FILTER (WHERE avg_speed_kmh IS NULL) * 100.0 / count(*), 6) AS missing_speed_percent,
              CAST(max(date) - min(date) + 1 AS INT) AS total_days FROM results""",
)
def rollup_completeness(v):
    return rollup.rollup_completeness(v.results)


@query("load_rollups", "weekly", """SELECT link_id, daytype, hour_of_day AS hour, round(avg_dur, 6) AS avg_duration_sec, round(avg_speed, 6) AS avg_speed_kmh FROM weekly""")
def load_rollups(v):
    from linkspark.sources import rollups, sinks
    from linkspark.workload.registry import work_folder

    folder = work_folder(v.spark)
    sinks.write_parquet(v.weekly, f"{folder}/weekly")
    return rollups.read_rollup(v.spark, f"{folder}/weekly").select(
        "link_id", "daytype", "hour", "avg_duration_sec", "avg_speed_kmh"
    )


# --- classes and scales ---

KNOWN = "(SELECT * FROM results WHERE avg_duration_sec IS NOT NULL)"
CLASS_SQL = """
SELECT link_id, CAST(date AS VARCHAR) AS date, hour, daytype,
       CAST(greatest(0, least({last}, len(list_filter(b, lambda x: x <= avg_duration_sec)) - 1)) AS INT) AS class_index
FROM {known}, (SELECT {breaks} AS b FROM {known})"""


def _classed(v, method, **kwargs):
    rows = v.results.where("avg_duration_sec IS NOT NULL")
    return classify.classify(rows, "avg_duration_sec", method, **kwargs).select(
        "link_id", "date", "hour", "daytype", "class_index"
    )


@query(
    "class_quantile",
    "results",
    CLASS_SQL.format(last=4, known=KNOWN, breaks="quantile_cont(avg_duration_sec, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])"),
)
def class_quantile(v):
    return _classed(v, "quantiles")


SPAN = "(max(avg_duration_sec) - min(avg_duration_sec))"
EQUAL_BREAKS = ", ".join(f"min(avg_duration_sec) + {SPAN} * {i} / 5" for i in range(5))


@query(
    "class_equal",
    "results",
    CLASS_SQL.format(last=4, known=KNOWN, breaks=f"[{EQUAL_BREAKS}, max(avg_duration_sec)]"),
)
def class_equal(v):
    return _classed(v, "equal_interval")


@query(
    "class_stddev",
    "results",
    CLASS_SQL.format(
        last=3, known=KNOWN,
        breaks="list_sort([least(avg(avg_duration_sec) - 2 * stddev_pop(avg_duration_sec), min(avg_duration_sec)), avg(avg_duration_sec) - stddev_pop(avg_duration_sec), "
               "avg(avg_duration_sec), avg(avg_duration_sec) + stddev_pop(avg_duration_sec), greatest(avg(avg_duration_sec) + 2 * stddev_pop(avg_duration_sec), max(avg_duration_sec))])",
    ),
)
def class_stddev(v):
    return _classed(v, "standard_deviation")


@query("class_manual", "results", CLASS_SQL.format(last=3, known=KNOWN, breaks="any_value([60.0, 180.0, 300.0, 600.0, 3600.0])"))
def class_manual(v):
    return _classed(v, "manual", manual_breaks=[600, 60, 180, 3600, 300])


@query(
    "capped_class",
    "results",
    f"""
SELECT link_id, CAST(date AS VARCHAR) AS date, hour, daytype, round(c, 6) AS capped_value,
       CAST(greatest(0, least(4, len(list_filter([q[1], q[1] + (q[2] - q[1]) * 1 / 5, q[1] + (q[2] - q[1]) * 2 / 5, q[1] + (q[2] - q[1]) * 3 / 5, q[1] + (q[2] - q[1]) * 4 / 5, q[2]],
            lambda x: x <= c)) - 1)) AS INT) AS color_index
FROM (SELECT *, greatest(q[1], least(q[2], avg_duration_sec)) AS c
      FROM {KNOWN}, (SELECT quantile_cont(avg_duration_sec, [0.02, 0.98]) AS q FROM {KNOWN}))""",
)
def capped_class(v):
    rows = v.results.where("avg_duration_sec IS NOT NULL")
    return classify.capped_classes(rows, "avg_duration_sec").select(
        "link_id", "date", "hour", "daytype", "capped_value", "color_index"
    )


@query(
    "width_scale",
    "results",
    """SELECT link_id, CAST(date AS VARCHAR) AS date, hour, daytype, round((ln(1 + n_valid) - lo) / (hi - lo) * 7 + 1, 6) AS line_width
       FROM results, (SELECT min(ln(1 + n_valid)) AS lo, max(ln(1 + n_valid)) AS hi FROM results)""",
)
def width_scale(v):
    return classify.width_scale(v.results, mapping="log").select("link_id", "date", "hour", "daytype", "line_width")


@query(
    "opacity_scale",
    "results",
    """SELECT link_id, CAST(date AS VARCHAR) AS date, hour, daytype, round((ln(1 + n_valid) - lo) / (hi - lo) * (1.0 - 0.3) + 0.3, 6) AS opacity
       FROM results, (SELECT min(ln(1 + n_valid)) AS lo, max(ln(1 + n_valid)) AS hi FROM results)""",
)
def opacity_scale(v):
    return classify.opacity_scale(v.results).select("link_id", "date", "hour", "daytype", "opacity")


@query(
    "color_ramp",
    "results",
    f"""
SELECT link_id, CAST(date AS VARCHAR) AS date, hour, daytype,
       CASE WHEN n IS NULL THEN '#999999' WHEN n < 0.5 THEN printf('#%02xff00', CAST(floor(n * 2 * 255) AS INT))
            ELSE printf('#ff%02x00', CAST(floor((1 - n) * 2 * 255) AS INT)) END AS color
FROM (SELECT r.*, CASE WHEN avg_duration_sec IS NOT NULL THEN greatest(0.0, least(1.0, (avg_duration_sec - q[1]) / (q[2] - q[1]))) END AS n
      FROM results r, (SELECT quantile_cont(avg_duration_sec, [0.05, 0.95]) AS q FROM {KNOWN}))""",
)
def color_ramp(v):
    return classify.color_ramp(v.results, "avg_duration_sec").select("link_id", "date", "hour", "daytype", "color")


@query(
    "traffic_class",
    "results",
    """SELECT link_id, CAST(date AS VARCHAR) AS date, hour, daytype, round(avg_duration_sec / 60, 6) AS duration_min,
              CASE WHEN avg_speed_kmh < 30 THEN 'red' WHEN avg_speed_kmh < 50 THEN 'orange' ELSE 'green' END AS color FROM results""",
)
def traffic_class(v):
    return classify.traffic_class(v.results, "speed").select("link_id", "date", "hour", "daytype", "duration_min", "color")


@query(
    "symbology",
    "results",
    f"""
SELECT link_id, CAST(date AS VARCHAR) AS date, hour, daytype,
       CAST(greatest(0, least(4, len(list_filter(b, lambda x: x <= avg_duration_sec)) - 1)) AS INT) AS class_index,
       round((n_valid - lo) / (hi - lo) * 7 + 1, 6) AS line_width,
       round((ln(1 + n_valid) - ln(1 + lo)) / (ln(1 + hi) - ln(1 + lo)) * 0.7 + 0.3, 6) AS opacity
FROM {KNOWN}, (SELECT quantile_cont(avg_duration_sec, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b, CAST(min(n_valid) AS DOUBLE) AS lo, CAST(max(n_valid) AS DOUBLE) AS hi FROM {KNOWN})""",
)
def symbology(v):
    rows = classify.symbology(v.results.where("avg_duration_sec IS NOT NULL"), "duration")
    return rows.select("link_id", "date", "hour", "daytype", "class_index", "line_width", "opacity")


@query(
    "quantiles",
    "big",
    """SELECT round(q[1], 6) AS q01, round(q[2], 6) AS q25, round(q[3], 6) AS median, round(q[4], 6) AS q999
       FROM (SELECT quantile_cont(duration, [0.01, 0.25, 0.5, 0.999]) AS q FROM big)""",
)
def quantiles(v):
    q = exact_quantiles(v.big, "duration", [0.01, 0.25, 0.5, 0.999])
    return q.select(*[F.col("q")[i].alias(n) for i, n in enumerate(["q01", "q25", "median", "q999"])])


# --- quality ---


def stats_sql(column: str, src: str = "results") -> str:
    return f"""count({column}) AS count, count(*) FILTER (WHERE {column} IS NULL) AS null_count, round(avg({column}), 6) AS mean,
       round(stddev_samp({column}), 6) AS std, round(min({column}), 6) AS min, round(max({column}), 6) AS max,
       round(quantile_cont({column}, 0.25), 6) AS q25, round(median({column}), 6) AS median, round(quantile_cont({column}, 0.75), 6) AS q75"""


def level_sql(score: str, a: int, b: int, c: int) -> str:
    return f"CASE WHEN {score} >= {a} THEN 'excellent' WHEN {score} >= {b} THEN 'good' WHEN {score} >= {c} THEN 'moderate' ELSE 'poor' END"


SPEED_SCORE = "greatest(0.0, 100 - (count(*) FILTER (WHERE avg_speed_kmh <= 0) + count(*) FILTER (WHERE avg_speed_kmh > 120)) * 100.0 / count(avg_speed_kmh))"
DURATION_SCORE = "greatest(0.0, 100 - (count(*) FILTER (WHERE avg_duration_sec <= 0) + count(*) FILTER (WHERE avg_duration_sec > 3600)) * 100.0 / count(avg_duration_sec))"
OBS_SCORE = "count(*) FILTER (WHERE n_valid >= 10) * 100.0 / count(n_valid)"


@query(
    "dq_summary",
    "links results",
    """SELECT (SELECT count(*) FROM links) AS network_features, count(*) AS results_records, count(DISTINCT link_id) AS unique_link_ids,
              CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date, count(DISTINCT date) AS unique_dates,
              min(hour) AS min_hour, max(hour) AS max_hour, CAST(count(DISTINCT hour) AS INT) AS unique_hours FROM results""",
)
def dq_summary(v):
    return quality.data_summary(v.links, v.results)


@query(
    "dq_speed",
    "results",
    f"""SELECT {stats_sql("avg_speed_kmh")}, count(*) FILTER (WHERE avg_speed_kmh <= 0) AS non_positive,
        count(*) FILTER (WHERE avg_speed_kmh > 0 AND avg_speed_kmh < 5) AS extreme_low, count(*) FILTER (WHERE avg_speed_kmh > 120) AS extreme_high,
        count(*) FILTER (WHERE avg_speed_kmh < 0.1 OR avg_speed_kmh > 200) AS out_of_range, round({SPEED_SCORE}, 6) AS quality_score,
        {level_sql(SPEED_SCORE, 95, 85, 70)} AS quality_level FROM results""",
)
def dq_speed(v):
    return quality.speed_quality(v.results)


@query(
    "dq_duration",
    "results",
    f"""SELECT {stats_sql("avg_duration_sec")}, count(*) FILTER (WHERE avg_duration_sec <= 0) AS non_positive,
        count(*) FILTER (WHERE avg_duration_sec > 0 AND avg_duration_sec < 30) AS extreme_short, count(*) FILTER (WHERE avg_duration_sec > 3600) AS extreme_long,
        count(*) FILTER (WHERE avg_duration_sec < 1 OR avg_duration_sec > 7200) AS out_of_range, round({DURATION_SCORE}, 6) AS quality_score,
        {level_sql(DURATION_SCORE, 95, 85, 70)} AS quality_level, round(avg(avg_duration_sec) / 60, 6) AS mean_minutes,
        round(median(avg_duration_sec) / 60, 6) AS median_minutes FROM results""",
)
def dq_duration(v):
    return quality.duration_quality(v.results)


@query(
    "dq_observations",
    "results",
    f"""SELECT {stats_sql("n_valid")}, count(*) FILTER (WHERE n_valid < 1) AS critical, count(*) FILTER (WHERE n_valid BETWEEN 1 AND 2) AS sparse,
        count(*) FILTER (WHERE n_valid < 10) AS unreliable, count(*) FILTER (WHERE n_valid >= 10) AS reliable, CAST(sum(n_valid) AS BIGINT) AS total_observations,
        round({OBS_SCORE}, 6) AS quality_score, {level_sql(OBS_SCORE, 80, 60, 40)} AS quality_level FROM results""",
)
def dq_observations(v):
    return quality.observation_quality(v.results)


@query(
    "dq_geometry",
    "link_lengths",
    f"""SELECT {stats_sql("length_m")}, count(*) AS total_features, CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS null_geometries,
        count(*) FILTER (WHERE length_m < 1) AS short_links, count(*) FILTER (WHERE length_m > 50000) AS long_links, 100.0 AS quality_score,
        'excellent' AS quality_level FROM link_lengths""",
)
def dq_geometry(v):
    return quality.geometry_quality(v.lines)


@query(
    "dq_overall",
    "results",
    f"""SELECT round(s, 6) AS speed_score, round(d, 6) AS duration_score, round(o, 6) AS observation_score, 100.0 AS geometry_score,
        round((s + d + o + 100) / 4, 6) AS overall_score,
        CASE WHEN (s + d + o + 100) / 4 >= 90 THEN 'excellent' WHEN (s + d + o + 100) / 4 >= 75 THEN 'good' WHEN (s + d + o + 100) / 4 >= 60 THEN 'moderate' ELSE 'poor' END AS overall_level
        FROM (SELECT {SPEED_SCORE} AS s, {DURATION_SCORE} AS d, {OBS_SCORE} AS o FROM results)""",
)
def dq_overall(v):
    return quality.overall_quality(v.lines, v.results)


@query(
    "dq_warnings",
    "links results",
    f"""
, c AS (SELECT count(*) FILTER (WHERE avg_speed_kmh > 0 AND avg_speed_kmh < 5) AS slow, count(*) FILTER (WHERE avg_speed_kmh > 120) AS fast,
               count(*) FILTER (WHERE avg_speed_kmh < 0.1 OR avg_speed_kmh > 200) AS speed_out, count(*) FILTER (WHERE avg_speed_kmh <= 0) AS speed_neg,
               count(*) FILTER (WHERE avg_duration_sec <= 0) AS dur_neg, count(*) FILTER (WHERE avg_duration_sec > 0 AND avg_duration_sec < 30) AS short,
               count(*) FILTER (WHERE avg_duration_sec > 3600) AS long, count(*) FILTER (WHERE avg_duration_sec < 1 OR avg_duration_sec > 7200) AS dur_out,
               count(*) FILTER (WHERE n_valid < 1) AS critical, count(*) FILTER (WHERE n_valid BETWEEN 1 AND 2) AS sparse, count(*) FILTER (WHERE n_valid < 10) AS unreliable FROM results),
  m AS ({MATCH_SQL}),
  w AS (SELECT 'Missing Geometry' AS category, missing_in_network || ' result links have no shapefile geometry' AS issue, 'High' AS severity, missing_in_network AS count, 'Update shapefile or verify link_id format' AS action FROM m
    UNION ALL SELECT 'Missing Results', missing_in_results || ' shapefile links have no result data', 'Medium', missing_in_results, 'Extend data collection or verify processing' FROM m
    UNION ALL SELECT 'Speed Quality', 'Found ' || speed_neg || ' non-positive speed values', 'Critical', speed_neg, 'Review data collection and calculation methods' FROM c
    UNION ALL SELECT 'Speed Quality', 'Found ' || slow || ' extremely low speeds (< 5.0 km/h)', 'Warning', slow, 'Investigate outliers and consider data validation rules' FROM c
    UNION ALL SELECT 'Speed Quality', 'Found ' || fast || ' extremely high speeds (> 120.0 km/h)', 'Warning', fast, 'Investigate outliers and consider data validation rules' FROM c
    UNION ALL SELECT 'Speed Quality', 'Found ' || speed_out || ' speeds outside valid range (0.1-200.0 km/h)', 'Info', speed_out, 'Review data quality procedures' FROM c
    UNION ALL SELECT 'Duration Quality', 'Found ' || dur_neg || ' non-positive duration values', 'Critical', dur_neg, 'Review data collection and calculation methods' FROM c
    UNION ALL SELECT 'Duration Quality', 'Found ' || short || ' extremely short durations (< 30.0 sec)', 'Warning', short, 'Investigate outliers and consider data validation rules' FROM c
    UNION ALL SELECT 'Duration Quality', 'Found ' || long || ' extremely long durations (> 3600.0 sec)', 'Warning', long, 'Investigate outliers and consider data validation rules' FROM c
    UNION ALL SELECT 'Duration Quality', 'Found ' || dur_out || ' durations outside valid range (1.0-7200.0 sec)', 'Info', dur_out, 'Review data quality procedures' FROM c
    UNION ALL SELECT 'Observation Quality', 'Found ' || critical || ' links with critically low observations (< 1)', 'Critical', critical, 'Increase observation frequency or extend collection period' FROM c
    UNION ALL SELECT 'Observation Quality', 'Found ' || sparse || ' links with sparse observations (1-3)', 'Info', sparse, 'Increase observation frequency or extend collection period' FROM c
    UNION ALL SELECT 'Observation Quality', 'Found ' || unreliable || ' links with unreliable observation counts (< 10)', 'Info', unreliable, 'Review data quality procedures' FROM c)
SELECT * FROM w WHERE count > 0""",
)
def dq_warnings(v):
    return quality.warning_table(v.links, v.lines, v.results)


# --- key figures ---

KPI_SQL = """
SELECT *, CASE WHEN data_quality_score >= 90 THEN 'excellent' WHEN data_quality_score >= 75 THEN 'good' WHEN data_quality_score >= 50 THEN 'moderate' ELSE 'poor' END AS quality_assessment,
       CASE WHEN coverage_percent >= 90 THEN 'excellent' WHEN coverage_percent >= 75 THEN 'good' WHEN coverage_percent >= 50 THEN 'moderate' ELSE 'limited' END AS coverage_quality,
       CASE WHEN n_days >= 30 THEN 'excellent' WHEN n_days >= 14 THEN 'good' WHEN n_days >= 7 THEN 'moderate' ELSE 'limited' END AS temporal_coverage
FROM (SELECT count(*) AS n_links_rendered, round(avg(avg_speed_kmh), 6) AS mean_speed, round(stddev_samp(avg_speed_kmh), 6) AS speed_std, round(min(avg_speed_kmh), 6) AS min_speed,
       round(max(avg_speed_kmh), 6) AS max_speed, round(median(avg_speed_kmh), 6) AS median_speed, round(avg(avg_duration_sec / 60), 6) AS mean_duration,
       round(stddev_samp(avg_duration_sec / 60), 6) AS duration_std, round(min(avg_duration_sec / 60), 6) AS min_duration, round(max(avg_duration_sec / 60), 6) AS max_duration,
       round(median(avg_duration_sec / 60), 6) AS median_duration, CAST(sum(n_valid) AS BIGINT) AS total_observations, round(avg(n_valid), 6) AS mean_observations_per_link,
       round(median(n_valid), 6) AS median_observations_per_link, round(sum(length_m) / 1000, 6) AS network_length_km, round(avg(length_m), 6) AS mean_link_length_m,
       round(median(length_m), 6) AS median_link_length_m, round(count(*) * 100.0 / (SELECT count(*) FROM links), 6) AS coverage_percent,
       (SELECT count(DISTINCT date) FROM results) AS n_days, round(100.0 * count(*) FILTER (WHERE n_valid < 5) / count(*), 6) AS sparse_links_percent,
       round(100 * (1 - count(*) FILTER (WHERE avg_speed_kmh > 0 AND avg_speed_kmh <= 200) / count(avg_speed_kmh)), 6) AS invalid_speeds_percent,
       round(100 * (1 - count(*) FILTER (WHERE avg_duration_sec > 0 AND avg_duration_sec <= 3600) / count(avg_duration_sec)), 6) AS invalid_durations_percent,
       round(((1 - count(*) FILTER (WHERE n_valid < 5) / count(*)) + count(*) FILTER (WHERE avg_speed_kmh > 0 AND avg_speed_kmh <= 200) / count(avg_speed_kmh)
              + count(*) FILTER (WHERE avg_duration_sec > 0 AND avg_duration_sec <= 3600) / count(avg_duration_sec)) / 3 * 100, 6) AS data_quality_score
      FROM map_base)"""


@query("kpis", "map_base links results", KPI_SQL)
def kpis(v):
    return kpi.kpis(v.map_base, v.links, v.results)


def _change_sql(metric: str, expr: str) -> str:
    return f"SELECT '{metric}' AS metric, (SELECT {expr} FROM map_base) AS previous, (SELECT {expr} FROM map_base WHERE hour BETWEEN 6 AND 9) AS current"


CHANGES = [
    ("coverage_percent", "count(*) * 100.0 / (SELECT count(*) FROM links)"),
    ("mean_speed", "avg(avg_speed_kmh)"),
    ("mean_duration", "avg(avg_duration_sec / 60)"),
    ("n_links_rendered", "CAST(count(*) AS DOUBLE)"),
    ("total_observations", "CAST(sum(n_valid) AS DOUBLE)"),
    ("network_length_km", "sum(length_m) / 1000"),
    ("data_quality_score",
     "((1 - count(*) FILTER (WHERE n_valid < 5) / count(*)) + count(*) FILTER (WHERE avg_speed_kmh > 0 AND avg_speed_kmh <= 200) / count(avg_speed_kmh) "
     "+ count(*) FILTER (WHERE avg_duration_sec > 0 AND avg_duration_sec <= 3600) / count(avg_duration_sec)) / 3 * 100"),
]


@query(
    "kpi_changes",
    "map_base links",
    "SELECT metric, round(previous, 6) AS previous, round(current, 6) AS current, round((current - previous) / previous * 100, 6) AS change_percent, "
    "CASE WHEN current > previous THEN 'up' WHEN current < previous THEN 'down' ELSE 'same' END AS direction FROM ("
    + " UNION ALL ".join(_change_sql(m, e) for m, e in CHANGES)
    + ")",
)
def kpi_changes(v):
    morning = filters.by_map_time(v.map_base, hours=(6, 9))
    return kpi.kpi_changes(kpi.kpis(v.map_base, v.links), kpi.kpis(morning, v.links))


@query(
    "filter_effect",
    "results",
    """SELECT original_records, filtered_records, round((original_records - filtered_records) * 100.0 / original_records, 6) AS filter_reduction_percent,
              CASE WHEN (original_records - filtered_records) * 100.0 / original_records > 80 THEN 'very_high' WHEN (original_records - filtered_records) * 100.0 / original_records > 60 THEN 'high'
                   WHEN (original_records - filtered_records) * 100.0 / original_records > 40 THEN 'moderate' WHEN (original_records - filtered_records) * 100.0 / original_records > 20 THEN 'low' ELSE 'minimal' END AS filter_effectiveness
       FROM (SELECT count(*) AS original_records, count(*) FILTER (WHERE hour BETWEEN 6 AND 15) AS filtered_records FROM results)""",
)
def filter_effect(v):
    return kpi.filter_effect(filters.by_map_time(v.results, hours=(6, 15)), v.results)


@query(
    "deviation",
    "hourly weekly",
    """SELECT h.link_id, CAST(h.date AS VARCHAR) AS date, h.hour_of_day, h.daytype, round(h.avg_duration_sec - w.avg_dur, 6) AS deviation_sec
       FROM hourly h JOIN weekly w ON h.link_id = w.link_id AND h.daytype = w.daytype AND h.hour_of_day = w.hour_of_day
       WHERE abs(h.avg_duration_sec - w.avg_dur) > 2 * w.std_dur""",
)
def deviation(v):
    return stream.deviations(v.hourly, v.weekly).select("link_id", "date", "hour_of_day", "daytype", "deviation_sec")
