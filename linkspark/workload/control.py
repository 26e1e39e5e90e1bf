"""Validation, extract, report and geometry queries."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import functions as F

from linkspark.config import CompletenessParams, ValidationParams
from linkspark.functions import bearings, geometry, projection
from linkspark.operators import control, spatial
from linkspark.workload.encoding import encode
from linkspark.workload.registry import query

SCHEDULE = CompletenessParams(date(2024, 1, 2), date(2024, 1, 4), 15)
METRIC = ValidationParams(crs_metric=None, polyline_precision=2)
FULL = ValidationParams(
    use_length_check=True, use_coverage_check=True, crs_metric=None, polyline_precision=2, coverage_spacing_m=5.0
)

# --- context, lookup, extracts ---


@query(
    "alt_context",
    "obs",
    """SELECT data_id, count(*) OVER (PARTITION BY name, "timestamp") AS n_alternatives,
              CASE WHEN count(*) OVER (PARTITION BY name, "timestamp") = 1 THEN 2 ELSE 3 END AS context_code FROM obs""",
)
def alt_context(v):
    return control.alternatives(v.obs).select("data_id", "n_alternatives", "context_code")


@query(
    "ref_lookup",
    "obs links",
    """SELECT data_id, o.name AS link_id, l.link_id IS NOT NULL AS in_network,
              CASE WHEN l.link_id IS NULL THEN 92 ELSE 0 END AS lookup_code
       FROM obs o LEFT JOIN links l ON o.name = l.link_id""",
)
def ref_lookup(v):
    found = control.reference_lookup(v.obs, v.links)
    return found.select("data_id", "link_id", "in_network", F.coalesce("lookup_code", F.lit(0)).alias("lookup_code"))


@query(
    "best_valid",
    "checked",
    """SELECT data_id, name, "timestamp", route_alternative FROM checked WHERE ok
       QUALIFY row_number() OVER (PARTITION BY name, "timestamp" ORDER BY
           -1000 * hausdorff_distance - 100 * abs(length_ratio - 1.0) + coverage_percent DESC, route_alternative, data_id) = 1""",
)
def best_valid(v):
    return control.best_valid(v.checked, ["route_alternative", "data_id"]).select(
        "data_id", "name", "timestamp", "route_alternative"
    )


@query(
    "failed_obs",
    "checked",
    """SELECT data_id, name, "timestamp" FROM checked QUALIFY NOT bool_or(ok) OVER (PARTITION BY name, "timestamp")""",
)
def failed_obs(v):
    return control.failed_observations(v.checked).select("data_id", "name", "timestamp")


FAILED_SQL = """(SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY name, "timestamp") AS any_ok FROM checked)
                WHERE NOT any_ok AND code BETWEEN 1 AND 3)"""


@query(
    "failed_geometry",
    "checked",
    f"""SELECT data_id, name, "timestamp", code AS valid_code FROM {FAILED_SQL}""",
)
def failed_geometry(v):
    return control.failed_geometry(v.checked).select("data_id", "name", "timestamp", "valid_code")


@query(
    "unique_routes",
    "checked",
    f"""SELECT data_id, name, polyline FROM {FAILED_SQL}
        QUALIFY row_number() OVER (PARTITION BY name, polyline ORDER BY data_id) = 1""",
)
def unique_routes(v):
    return control.unique_routes(control.failed_geometry(v.checked), ["data_id"]).select("data_id", "name", "polyline")


@query("no_data_links", "links obs", "SELECT link_id, false AS is_valid, 95 AS valid_code FROM links WHERE link_id NOT IN (SELECT name FROM obs)")
def no_data_links(v):
    return control.no_data_links(v.obs, v.links)


@query(
    "missing_obs",
    "obs",
    """SELECT e.link_id, CAST(e.date AS VARCHAR) AS date, e.requested_time, false AS is_valid, 94 AS valid_code
       FROM (SELECT link_id, CAST(slot AS DATE) AS date, strftime(slot, '%H:%M:%S') AS requested_time
             FROM (SELECT DISTINCT name AS link_id FROM obs),
                  (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-04 23:45:00', INTERVAL 15 MINUTE)) AS slot)) e
       ANTI JOIN (SELECT name, CAST("timestamp" AS DATE) AS date, requested_time FROM obs) o
         ON e.link_id = o.name AND e.date = o.date AND e.requested_time = o.requested_time""",
)
def missing_obs(v):
    return control.missing_observations(v.obs, SCHEDULE)


REPORT_CTE = """
SELECT l.link_id, l.from_id, l.to_id, coalesce(total, 0) AS total_observations, coalesce(good, 0) AS successful_observations,
       coalesce(total - good, 0) AS failed_observations, coalesce(routes, 0) AS total_routes,
       coalesce(single_, 0) AS single_route_observations, coalesce(multi_, 0) AS multi_route_observations,
       round(perfect * 100.0 / total, 6) AS perfect_match_percent, round(threshold * 100.0 / total, 6) AS threshold_pass_percent,
       round((total - good) * 100.0 / total, 6) AS failed_percent, round(good * 100.0 / total, 6) AS success_rate,
       round(perfect * 100.0 / total + threshold * 100.0 / total, 6) AS total_success_rate,
       CASE WHEN total IS NULL THEN 41 WHEN alts AND good = total THEN 30 WHEN alts AND good > 0 THEN 31 WHEN alts THEN 32
            WHEN good = total THEN 0 WHEN good > 0 THEN 21 ELSE 22 END AS result_code,
       CASE WHEN total IS NULL THEN 'did not record' WHEN alts THEN 'RouteAlternative greater than one'
            WHEN good = total THEN 'valid' WHEN good > 0 THEN 'no RouteAlternative'
            ELSE 'no RouteAlternative and all invalid' END AS result_label,
       round(good * 100.0 / total, 6) AS num, CAST(288 AS BIGINT) AS expected_observations,
       greatest(0, 288 - coalesce(total, 0)) AS missing_observations,
       round(coalesce(total, 0) * 100.0 / 288, 6) AS data_coverage_percent
FROM links l LEFT JOIN (
    SELECT name, count(*) AS total, count(*) FILTER (WHERE ok) AS good,
           count(*) FILTER (WHERE ok AND near < 1e-6) AS perfect, count(*) FILTER (WHERE ok AND near >= 1e-6) AS threshold,
           CAST(sum(n) AS BIGINT) AS routes, count(*) FILTER (WHERE n = 1) AS single_, count(*) FILTER (WHERE n > 1) AS multi_,
           max(n) > 1 OR max(hi) > 1 AS alts
    FROM (SELECT name, "timestamp", count(*) AS n, bool_or(ok) AS ok, min(hausdorff_distance) FILTER (WHERE ok) AS near,
                 max(route_alternative) AS hi
          FROM (SELECT * FROM checked {where} QUALIFY row_number() OVER (PARTITION BY name, "timestamp", polyline ORDER BY data_id) = 1)
          GROUP BY name, "timestamp")
    GROUP BY name) s ON l.link_id = s.name"""
REPORT_FIELDS = [
    "link_id", "from_id", "to_id", "total_observations", "successful_observations", "failed_observations",
    "total_routes", "single_route_observations", "multi_route_observations", "perfect_match_percent",
    "threshold_pass_percent", "failed_percent", "success_rate", "total_success_rate", "result_code", "result_label",
    "num", "expected_observations", "missing_observations", "data_coverage_percent",
]


@query("link_report", "links checked", REPORT_CTE.format(where=""))
def link_report(v):
    return control.link_report(v.checked, v.links, ["data_id"], SCHEDULE).select(*REPORT_FIELDS)


@query(
    "link_report_dates",
    "links checked",
    REPORT_CTE.format(where="""WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-04'"""),
)
def link_report_dates(v):
    report = control.link_report(
        v.checked, v.links, ["data_id"], SCHEDULE, start_date=SCHEDULE.start_date, end_date=SCHEDULE.end_date
    )
    return report.select(*REPORT_FIELDS)


@query(
    "result_code",
    "obs",
    """SELECT name AS link_id, total AS total_timestamps, good AS successful_timestamps,
              CASE WHEN alts AND good = total THEN 30 WHEN alts AND good > 0 THEN 31 WHEN alts THEN 32 WHEN good = total THEN 0
                   WHEN good > 0 THEN 21 ELSE 22 END AS result_code, round(good * 100.0 / total, 6) AS num
       FROM (SELECT name, count(*) AS total, count(*) FILTER (WHERE ok) AS good, max(n) > 1 OR max(hi) > 1 AS alts
             FROM (SELECT name, "timestamp", count(*) AS n, bool_or(is_valid) AS ok, max(route_alternative) AS hi
                   FROM obs GROUP BY name, "timestamp") GROUP BY name)""",
)
def result_code(v):
    coded = control.with_result_code(control.link_statistics(v.obs))
    return coded.select("link_id", "total_timestamps", "successful_timestamps", "result_code", "num")


@query(
    "failure_periods",
    "checked links",
    f"""SELECT name AS link_id, arg_min(code, data_id) AS valid_code, count(DISTINCT CAST("timestamp" AS DATE)) AS total_days,
       count(*) AS total_fail,
       round(count(*) FILTER (WHERE h < 6) / count(DISTINCT d), 2) AS fail_00_06,
       round(count(*) FILTER (WHERE h >= 6 AND h < 11) / count(DISTINCT d), 2) AS fail_06_11,
       round(count(*) FILTER (WHERE h >= 11 AND h < 15) / count(DISTINCT d), 2) AS fail_11_15,
       round(count(*) FILTER (WHERE h >= 15 AND h < 20) / count(DISTINCT d), 2) AS fail_15_20,
       round(count(*) FILTER (WHERE h >= 20) / count(DISTINCT d), 2) AS fail_20_00,
       round(avg(hausdorff_distance), 6) AS avg_hausdorff, min(hausdorff_distance) AS best_hausdorff, max(hausdorff_distance) AS worst_hausdorff,
       round(avg(length_ratio), 6) AS avg_length_ratio, round(min(length_ratio), 6) AS best_length_ratio, round(max(length_ratio), 6) AS worst_length_ratio,
       round(avg(coverage_percent), 6) AS avg_coverage, max(coverage_percent) AS best_coverage, min(coverage_percent) AS worst_coverage
FROM (SELECT *, hour("timestamp") AS h, CAST("timestamp" AS DATE) AS d FROM {FAILED_SQL}) GROUP BY name""",
)
def failure_periods(v):
    return control.failure_periods(control.failed_geometry(v.checked), v.links, "data_id")


@query(
    "code_histogram",
    "checked",
    """SELECT code AS valid_code, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM checked), 6) AS percentage,
              CASE code WHEN 92 THEN 'Link not in shapefile' WHEN 2 THEN 'Single route alternative' ELSE 'Multiple route alternatives' END AS description
       FROM checked GROUP BY code""",
)
def code_histogram(v):
    return control.code_histogram(v.checked)


@query(
    "observation_summary",
    "checked",
    """SELECT total_routes, valid_routes, total_observations, valid_observations, round(valid_routes * 100.0 / total_routes, 6) AS valid_routes_percent,
              round(valid_observations * 100.0 / total_observations, 6) AS valid_observations_percent
       FROM (SELECT CAST(sum(n) AS BIGINT) AS total_routes, CAST(sum(good) AS BIGINT) AS valid_routes, count(*) AS total_observations,
                    count(*) FILTER (WHERE good > 0) AS valid_observations
             FROM (SELECT count(*) AS n, count(*) FILTER (WHERE hausdorff_pass) AS good FROM checked GROUP BY name, "timestamp"))""",
)
def observation_summary(v):
    return control.observation_summary(v.checked)


@query(
    "failure_groups",
    "checked",
    """SELECT name AS link_id, "timestamp", count(*) AS routes_tested,
       CASE WHEN bool_or(hausdorff_pass) AND bool_or(length_pass) AND bool_or(coverage_pass) THEN 'Unknown' ELSE
       concat_ws('; ', CASE WHEN NOT bool_or(hausdorff_pass) THEN format('Hausdorff: {:.2f}m', avg(hausdorff_distance)) END,
                 CASE WHEN NOT bool_or(length_pass) THEN format('Length ratio: {:.3f}', avg(length_ratio)) END,
                 CASE WHEN NOT bool_or(coverage_pass) THEN format('Coverage: {:.1f}%', avg(coverage_percent)) END) END AS failure_reasons
       FROM checked GROUP BY name, "timestamp" HAVING NOT bool_or(ok)""",
)
def failure_groups(v):
    return control.failure_groups(v.checked)


@query(
    "failure_reason",
    "checked",
    """SELECT data_id, CASE WHEN hausdorff_pass AND length_pass AND coverage_pass
              THEN CASE WHEN code = 92 THEN 'Link not in shapefile' ELSE 'Unknown failure' END ELSE
       concat_ws('; ', CASE WHEN NOT hausdorff_pass THEN format('Hausdorff: {:.1f}m', hausdorff_distance) END,
                 CASE WHEN NOT length_pass THEN format('Length: {:.2f}x', length_ratio) END,
                 CASE WHEN NOT coverage_pass THEN format('Coverage: {:.1f}%', coverage_percent) END) END AS reason
       FROM checked WHERE NOT ok""",
)
def failure_reason(v):
    failed = v.checked.where("NOT is_valid")
    return failed.select("data_id", control.failure_reason(failed).alias("reason"))


# --- geometry ---


@query(
    "segments",
    "link_segments",
    """SELECT link_id, seq, x1, y1, x2, y2, round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) AS segment_length FROM link_segments""",
)
def segments(v):
    return spatial.explode_segments(v.lines.select("link_id", "line"))


@query("line_length", "link_lengths", "SELECT link_id, round(length_m, 6) AS length_m FROM link_lengths")
def line_length(v):
    return v.measured_lines.select("link_id", "length_m")


@query(
    "link_lines",
    "link_vertices",
    """SELECT link_id, 'LINESTRING (' || string_agg(x || ' ' || y, ', ' ORDER BY seq) || ')' AS wkt, count(*) AS n_vertices
       FROM link_vertices GROUP BY link_id""",
)
def link_lines(v):
    vertices = spatial.explode_vertices(v.lines.select("link_id", "line"))
    lines = spatial.lines_from_vertices(vertices, ["link_id"])
    return lines.select(
        "link_id", geometry.to_wkt(F.col("line")).alias("wkt"), F.size("line").cast("bigint").alias("n_vertices")
    )


@query(
    "route_vertices",
    "route_vertices",
    """SELECT route_id, seq, round(34.5 + (k % 100) * 0.01 + seq * 0.002, 5) AS x,
              round(31.0 + (k // 100 % 100) * 0.01 + ((k * seq) % 3) * 0.0005 + v * 0.00002, 5) AS y FROM route_vertices""",
    digits=5,
)
def route_vertices(v):
    texts = v.geo_routes.select("route_id", F.col("polyline").alias("encoded"))
    observed = v.obs.join(texts, F.col("polyline") == F.col("route_id")).select("encoded")
    decoded = spatial.decode_routes(observed, "encoded").join(texts, "encoded")
    return spatial.explode_vertices(decoded.select("route_id", "line"))


@query(
    "hausdorff",
    "pair_distance",
    "SELECT route_id, link_id, round(hausdorff_distance, 6) AS hausdorff_distance, hausdorff_distance <= 5 AS hausdorff_pass FROM pair_distance",
)
def hausdorff(v):
    pairs = v.routes.withColumnRenamed("line", "route").join(
        v.lines.select("link_id", F.col("line").alias("reference")), "link_id"
    )
    measured = control.measure_pairs(pairs, ValidationParams())
    return measured.select("route_id", "link_id", "hausdorff_distance", "hausdorff_pass")


@query(
    "length_test",
    "link_lengths route_segments",
    """SELECT route_id, link_id, round(m / length_m, 6) AS length_ratio, length_m < 20 OR m / length_m BETWEEN 0.9 AND 1.1 AS length_pass
       FROM (SELECT r.route_id, r.link_id, l.length_m, CASE WHEN ends_with(route_id, '_1') THEN 0.8 ELSE 1.0 END *
                    sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS m
             FROM route_segments r JOIN link_lengths l ON r.link_id = l.link_id GROUP BY r.route_id, r.link_id, l.length_m)""",
)
def length_test(v):
    # the second variant is drawn at four fifths of its size
    factor = F.when(F.col("v") == 1, 0.8).otherwise(1.0)
    routes = v.routes.withColumn(
        "route", F.transform("line", lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y")))
    )
    pairs = routes.join(v.lines.select("link_id", F.col("line").alias("reference")), "link_id")
    params = ValidationParams(use_hausdorff=False, use_length_check=True)
    return control.measure_pairs(pairs, params).select("route_id", "link_id", "length_ratio", "length_pass")


COVERAGE_CTE = """
, steps AS (SELECT link_id, seq, x1, y1, x2, y2, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len,
                   CAST(greatest(1, ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 5.0)) AS INT) AS n FROM link_segments),
  points AS (SELECT link_id, seq, i, x1 + (x2 - x1) * (i - 0.5) / n AS x, y1 + (y2 - y1) * (i - 0.5) / n AS y, len / n AS step
             FROM steps, range(1, 1000) AS r(i) WHERE i <= n),
  near AS (SELECT route_id, link_id, seq, i, any_value(step) AS step, min(d) AS d FROM (
               SELECT s.route_id, p.link_id, p.seq, p.i, p.step,
                      sqrt((p.x - (s.x1 + t.t * (s.x2 - s.x1))) ** 2 + (p.y - (s.y1 + t.t * (s.y2 - s.y1))) ** 2) AS d
               FROM points p JOIN route_segments s ON p.link_id = s.link_id,
                    (SELECT greatest(0, least(1, ((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1))
                                     / ((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2))) AS t) t)
           GROUP BY route_id, link_id, seq, i),
  share AS (SELECT route_id, link_id, coalesce(sum(step) FILTER (WHERE d <= 1e-6), 0) AS strict, coalesce(sum(step) FILTER (WHERE d <= 5), 0) AS loose, sum(step) AS total
            FROM near GROUP BY route_id, link_id)
"""


@query(
    "coverage",
    "routes link_segments route_segments",
    COVERAGE_CTE
    + """
SELECT route_id, link_id, round(100 * least(1.0, CASE WHEN strict > 0 THEN strict ELSE loose END / total), 4) AS coverage_percent,
       CASE WHEN strict > 0 THEN strict ELSE loose END / total >= 0.85 AS coverage_pass FROM share""",
    digits=4,
)
def coverage(v):
    pairs = v.routes.withColumnRenamed("line", "route").join(
        v.lines.select("link_id", F.col("line").alias("reference")), "link_id"
    )
    params = ValidationParams(use_hausdorff=False, use_coverage_check=True, coverage_spacing_m=5.0)
    return control.measure_pairs(pairs, params).select("route_id", "link_id", "coverage_percent", "coverage_pass")


def _raw(v):
    """Observations as they arrive: encoded routes, some broken names, routes and times."""
    encoded = v.routes.select(
        F.col("route_id"), encode(F.col("line"), METRIC.polyline_precision).alias("encoded")
    )
    joined = v.obs.join(encoded, F.col("polyline") == F.col("route_id"))
    return joined.selectExpr(
        "data_id", "route_alternative",
        "CASE WHEN data_id % 101 = 0 THEN concat('link ', k) ELSE name END AS name",
        "CASE WHEN data_id % 103 = 0 THEN 'INVALID_POLYLINE' WHEN data_id % 107 = 0 THEN NULL ELSE encoded END AS polyline",
        "CASE WHEN data_id % 109 = 0 THEN NULL ELSE timestamp END AS timestamp",
    )


VALIDATE_SQL = """
, raw AS (SELECT data_id, route_alternative, polyline AS route_id, CASE WHEN data_id % 101 = 0 THEN 'link ' || k ELSE name END AS name,
                 CASE WHEN data_id % 103 = 0 THEN 'bad' WHEN data_id % 107 = 0 THEN NULL ELSE 'ok' END AS route,
                 CASE WHEN data_id % 109 = 0 THEN NULL ELSE "timestamp" END AS "timestamp" FROM obs),
  coded AS (SELECT r.*, p.hausdorff_distance,
                   CASE WHEN route IS NULL {time} THEN 90 WHEN name LIKE 'link %' THEN 91 WHEN l.link_id IS NULL THEN 92
                        WHEN route = 'bad' THEN 93 ELSE {context} END AS valid_code
            FROM raw r LEFT JOIN links l ON r.name = l.link_id LEFT JOIN pair_distance p ON p.route_id = r.route_id)
SELECT data_id, valid_code, valid_code < 90 AND hausdorff_distance <= 5 AS is_valid,
       CASE WHEN valid_code < 90 THEN round(hausdorff_distance, 6) END AS hausdorff_distance FROM coded"""


@query(
    "validate_obs",
    "obs links pair_distance",
    VALIDATE_SQL.format(
        time='OR "timestamp" IS NULL',
        context='CASE WHEN count(*) OVER (PARTITION BY name, "timestamp") = 1 THEN 2 ELSE 3 END',
    ).replace("valid_code < 90 AND hausdorff_distance <= 5", "coalesce(valid_code < 90 AND hausdorff_distance <= 5, false)"),
)
def validate_obs(v):
    return control.validate(_raw(v), v.lines, METRIC).select("data_id", "valid_code", "is_valid", "hausdorff_distance")


@query(
    "validate_geometry_only",
    "obs links pair_distance",
    VALIDATE_SQL.format(time="", context="1").replace(
        "valid_code < 90 AND hausdorff_distance <= 5", "coalesce(valid_code < 90 AND hausdorff_distance <= 5, false)"
    ),
)
def validate_geometry_only(v):
    raw = _raw(v).drop("route_alternative")
    return control.validate(raw, v.lines, METRIC).select("data_id", "valid_code", "is_valid", "hausdorff_distance")


ALL_TESTS_SQL = (
    COVERAGE_CTE
    + VALIDATE_SQL.format(
        time='OR "timestamp" IS NULL',
        context='CASE WHEN count(*) OVER (PARTITION BY name, "timestamp") = 1 THEN 2 ELSE 3 END',
    ).split("SELECT data_id, valid_code,")[0]
    + """
SELECT data_id, valid_code, coalesce(valid_code < 90 AND hausdorff_distance <= 5 AND part >= 0.85, false) AS is_valid,
       coalesce(valid_code < 90 AND hausdorff_distance <= 5, false) AS hausdorff_pass,
       CASE WHEN valid_code < 90 THEN 1.0 ELSE -1.0 END AS length_ratio, valid_code < 90 AS length_pass,
       CASE WHEN valid_code < 90 THEN round(100 * part, 4) ELSE -1.0 END AS coverage_percent,
       coalesce(valid_code < 90 AND part >= 0.85, false) AS coverage_pass
FROM coded c LEFT JOIN (SELECT route_id, least(1.0, CASE WHEN strict > 0 THEN strict ELSE loose END / total) AS part FROM share) s
     ON s.route_id = c.route_id"""
)


@query("validate_all_tests", "obs links routes link_segments route_segments pair_distance", ALL_TESTS_SQL, digits=4)
def validate_all_tests(v):
    out = control.validate(_raw(v), v.lines, FULL)
    passed = {c: F.coalesce(c, F.lit(False)) for c in ("hausdorff_pass", "length_pass", "coverage_pass")}
    values = {c: F.coalesce(c, F.lit(-1.0)) for c in ("length_ratio", "coverage_percent")}
    return out.withColumns(passed | values).select("data_id", "valid_code", "is_valid", *passed, *values)


@query(
    "obs_geometry",
    "obs links",
    """SELECT data_id, CASE WHEN data_id % 103 = 0 OR data_id % 107 = 0 THEN 'reference' ELSE 'route' END AS geometry_source,
              CASE WHEN data_id % 103 = 0 OR data_id % 107 = 0 THEN 0 WHEN v = 1 THEN 2 WHEN v = 2 THEN 4 WHEN v = 3 THEN 8 ELSE 0 END AS first_y
       FROM obs o LEFT JOIN links l ON l.link_id = CASE WHEN data_id % 101 = 0 THEN 'link' ELSE o.name END
       WHERE NOT (data_id % 103 = 0 OR data_id % 107 = 0) OR l.link_id IS NOT NULL""",
)
def obs_geometry(v):
    rows = spatial.observation_geometry(_raw(v), v.lines, precision=METRIC.polyline_precision)
    return rows.select("data_id", "geometry_source", F.element_at("line", 1)["y"].cast("int").alias("first_y"))


@query(
    "select_box",
    "link_segments",
    """SELECT DISTINCT link_id FROM link_segments WHERE
         -- slab clipping of the segment against the box
         greatest(CASE WHEN x2 <> x1 THEN least((4100 - x1) / (x2 - x1), (9300 - x1) / (x2 - x1)) ELSE CASE WHEN x1 BETWEEN 4100 AND 9300 THEN 0 ELSE 2 END END,
                  CASE WHEN y2 <> y1 THEN least((10 - y1) / (y2 - y1), (60 - y1) / (y2 - y1)) ELSE CASE WHEN y1 BETWEEN 10 AND 60 THEN 0 ELSE 2 END END, 0)
         <= least(CASE WHEN x2 <> x1 THEN greatest((4100 - x1) / (x2 - x1), (9300 - x1) / (x2 - x1)) ELSE 1 END,
                  CASE WHEN y2 <> y1 THEN greatest((10 - y1) / (y2 - y1), (60 - y1) / (y2 - y1)) ELSE 1 END, 1)""",
)
def select_box(v):
    return spatial.select_box(v.lines, 4100, 10, 9300, 60).select("link_id")


@query(
    "select_viewport",
    "link_vertices",
    """SELECT link_id FROM link_vertices GROUP BY link_id HAVING max(x) >= 4500 AND min(x) <= 10500""",
)
def select_viewport(v):
    return spatial.select_viewport(v.lines, (5000, -1000, 10000, 1000)).select("link_id")


LASSO = [(2100.0, -50.0), (8500.0, -50.0), (8500.0, 30.0), (5000.0, 120.0), (2100.0, 30.0)]


@query(
    "select_lasso",
    "link_vertices link_segments",
    """
, ring(px1, py1, px2, py2) AS (VALUES (2100.0, -50.0, 8500.0, -50.0), (8500.0, -50.0, 8500.0, 30.0), (8500.0, 30.0, 5000.0, 120.0),
                                      (5000.0, 120.0, 2100.0, 30.0), (2100.0, 30.0, 2100.0, -50.0)),
  inside AS (SELECT link_id FROM link_vertices, ring GROUP BY link_id, seq, x, y
             HAVING count(*) FILTER (WHERE (py1 > y) <> (py2 > y) AND x < (px2 - px1) * (y - py1) / CASE WHEN py2 = py1 THEN 1 ELSE py2 - py1 END + px1) % 2 = 1),
  crossing AS (SELECT link_id FROM link_segments, ring WHERE
        sign((px2 - px1) * (y1 - py1) - (py2 - py1) * (x1 - px1)) * sign((px2 - px1) * (y2 - py1) - (py2 - py1) * (x2 - px1)) < 0
    AND sign((x2 - x1) * (py1 - y1) - (y2 - y1) * (px1 - x1)) * sign((x2 - x1) * (py2 - y1) - (y2 - y1) * (px2 - x1)) < 0)
SELECT link_id FROM inside UNION SELECT link_id FROM crossing""",
)
def select_lasso(v):
    return spatial.select_polygon(v.lines, LASSO).select("link_id")


@query(
    "select_zones",
    "link_segments",
    """SELECT DISTINCT zone_id, link_id FROM link_segments
       JOIN (SELECT CAST(n_nationkey AS BIGINT) AS zone_id, n_nationkey * 700.0 AS a, n_nationkey * 700.0 + 200 + n_regionkey * 900.0 AS b,
                    n_regionkey * 12.0 - 5 AS c, n_regionkey * 12.0 + 30 AS d FROM nation)
       ON greatest(CASE WHEN x2 <> x1 THEN least((a - x1) / (x2 - x1), (b - x1) / (x2 - x1)) ELSE CASE WHEN x1 BETWEEN a AND b THEN 0 ELSE 2 END END,
                   CASE WHEN y2 <> y1 THEN least((c - y1) / (y2 - y1), (d - y1) / (y2 - y1)) ELSE CASE WHEN y1 BETWEEN c AND d THEN 0 ELSE 2 END END, 0)
       <= least(CASE WHEN x2 <> x1 THEN greatest((a - x1) / (x2 - x1), (b - x1) / (x2 - x1)) ELSE 1 END,
                CASE WHEN y2 <> y1 THEN greatest((c - y1) / (y2 - y1), (d - y1) / (y2 - y1)) ELSE 1 END, 1)""",
)
def select_zones(v):
    # a zone for every nation: rectangles of different sizes that overlap
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    a, c = key * 700.0, region * 12.0 - 5
    corners = [(a, c), (a + 200 + region * 900.0, c), (a + 200 + region * 900.0, region * 12.0 + 30), (a, region * 12.0 + 30)]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    zones = v.table("nation").select(key.cast("bigint").alias("zone_id"), ring.alias("ring"))
    return spatial.select_zones(v.lines, zones).select("zone_id", "link_id")


@query(
    "octants",
    "link_vertices",
    """SELECT link_id, round((degrees(atan2(dx, dy)) + 360) % 360, 6) AS bearing,
              CAST(floor(((degrees(atan2(dx, dy)) + 360) % 360 + 22.5) % 360 / 45) AS INT) + 1 AS code,
              ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(((degrees(atan2(dx, dy)) + 360) % 360 + 22.5) % 360 / 45) AS INT) + 1] AS direction
       FROM (SELECT link_id, arg_max(x, seq) - arg_min(x, seq) AS dx, arg_max(y, seq) - arg_min(y, seq) AS dy FROM link_vertices GROUP BY link_id)""",
)
def octants(v):
    start, end = geometry.first_point(F.col("line")), geometry.last_point(F.col("line"))
    bearing = bearings.planar_bearing(start["x"], start["y"], end["x"], end["y"])
    coded = v.lines.select("link_id", bearing.alias("bearing")).withColumn("code", bearings.octant_code(F.col("bearing")))
    return coded.withColumn("direction", bearings.octant_name(F.col("code")))


AZIMUTH_CTE = """
, -- recursive
  ends AS (SELECT DISTINCT polyline AS kid, 34.5::DOUBLE + (k % 100) * 0.01::DOUBLE AS lon1,
                  31.0::DOUBLE + (k // 100 % 100) * 0.01::DOUBLE + v * 0.00002::DOUBLE AS lat1,
                  34.5::DOUBLE + (k % 100) * 0.01::DOUBLE + (3 + k % 3) * 0.002::DOUBLE AS lon2,
                  31.0::DOUBLE + (k // 100 % 100) * 0.01::DOUBLE + ((k * (3 + k % 3)) % 3) * 0.0005::DOUBLE + v * 0.00002::DOUBLE AS lat2
           FROM obs),
  pairs AS (SELECT kid, 'regular' AS kind, lon1 AS a1, lat1 AS b1, lon2 AS a2, lat2 AS b2 FROM ends
           UNION ALL SELECT kid, 'swapped', lat1, lon1, lat2, lon2 FROM ends),
  start AS (SELECT kid, kind, 1 / 298.257223563 AS f, atan((1 - 1 / 298.257223563) * tan(radians(b1))) AS u1,
                   atan((1 - 1 / 298.257223563) * tan(radians(b2))) AS u2, radians(a2 - a1) AS l FROM pairs),
  step AS (SELECT *, l AS lam, 0 AS n FROM start
           UNION ALL
           SELECT kid, kind, f, u1, u2, l,
                  l + (1 - c) * f * sa * (atan2(ss, cs) + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))) AS lam, n + 1 AS n
           FROM (SELECT *, f / 16 * c2a * (4 + f * (4 - 3 * c2a)) AS c,
                        CASE WHEN c2a <> 0 THEN cs - 2 * sin(u1) * sin(u2) / c2a ELSE 0 END AS c2m
                 FROM (SELECT *, 1 - sa * sa AS c2a
                       FROM (SELECT *, CASE WHEN ss <> 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa
                             FROM (SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss,
                                          sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs
                                   FROM step WHERE n < 20))))),
  solved AS (SELECT kid, kind,
                    (degrees(atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))) + 360) % 360 AS fwd,
                    (degrees(atan2(cos(u1) * sin(lam), cos(u1) * sin(u2) * cos(lam) - sin(u1) * cos(u2))) + 540) % 360 AS back
             FROM step WHERE n = 20),
  wide AS (SELECT e.*, r.fwd AS fwd, r.back AS back, s.fwd AS fwd_sw, s.back AS back_sw,
                  (degrees(atan2(lon2 - lon1, lat2 - lat1)) + 360) % 360 AS plane
           FROM ends e JOIN solved r ON e.kid = r.kid AND r.kind = 'regular' JOIN solved s ON e.kid = s.kid AND s.kind = 'swapped'),
  fixed AS (SELECT *, CASE WHEN abs((fwd_sw - plane + 540) % 360 - 180) + 1e-9 < abs((fwd - plane + 540) % 360 - 180)
                                AND abs((fwd_sw - plane + 540) % 360 - 180) <= 45 THEN 1 ELSE 0 END AS axis_fix FROM wide),
  chosen AS (SELECT *, CASE WHEN axis_fix = 1 THEN fwd_sw ELSE fwd END AS azi_a, CASE WHEN axis_fix = 1 THEN back_sw ELSE back END AS azi_b FROM fixed),
  coded AS (SELECT *, CAST(floor((azi_a + 22.5) % 360 / 45) AS INT) + 1 AS code_a, CAST(floor((azi_b + 22.5) % 360 / 45) AS INT) + 1 AS code_b FROM chosen)
"""


@query(
    "azimuth_ids",
    "obs",
    AZIMUTH_CTE
    + """SELECT kid, kid || '-' || code_b || code_a AS "Id", code_a, code_b, code_b || '-' || code_a AS travel_mode, axis_fix,
       round(azi_a, 6) AS azi_a, round(azi_b, 6) AS azi_b, round(fwd, 6) AS azi_a_raw, round(fwd_sw, 6) AS azi_a_sw, round(plane, 6) AS azi_a_pl,
       ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][code_a] AS dir_a, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][code_b] AS dir_b FROM coded""",
)
def azimuth_ids(v):
    table = spatial.azimuth_table(v.geo_routes.withColumnRenamed("link_id", "link"), key="route_id")
    return table.select(
        "kid", "Id", "code_a", "code_b", "travel_mode", "axis_fix", "azi_a", "azi_b", "azi_a_raw", "azi_a_sw",
        "azi_a_pl", "dir_a", "dir_b",
    )


@query(
    "azimuth_diag",
    "obs",
    AZIMUTH_CTE
    + """SELECT round(avg(d), 6) AS avg_diff, round(max(d), 6) AS max_diff, count(*) FILTER (WHERE d > 90) AS flips, CAST(sum(axis_fix) AS BIGINT) AS axis_fixes
       FROM (SELECT axis_fix, abs((azi_a - plane + 540) % 360 - 180) AS d FROM coded)""",
)
def azimuth_diag(v):
    return spatial.azimuth_diagnostics(spatial.azimuth_table(v.geo_routes, key="route_id"))


@query(
    "request_table",
    "obs",
    AZIMUTH_CTE
    + """SELECT kid || '-' || code_b || code_a AS "Id", 0 AS mode, printf('%.15f,%.15f', lat1, lon1) AS start_coord, printf('%.15f,%.15f', lat2, lon2) AS end_coord FROM coded""",
)
def request_table(v):
    return spatial.request_table(spatial.azimuth_table(v.geo_routes, key="route_id"))


@query(
    "project_web",
    "route_vertices",
    """SELECT route_id, seq, round(radians(lon) * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 4) AS y
       FROM (SELECT route_id, seq, 34.5 + (k % 100) * 0.01 + seq * 0.002 AS lon,
                    31.0 + (k // 100 % 100) * 0.01 + ((k * seq) % 3) * 0.0005 + v * 0.00002 AS lat FROM route_vertices)""",
    digits=4,
)
def project_web(v):
    return spatial.explode_vertices(spatial.project(v.geo_routes.select("route_id", "line"), "EPSG:3857"))


def _grid_sql() -> str:
    """SQL for metric coordinates in EPSG:2039: datum shift by seven parameters, then Transverse Mercator by the Krueger series."""
    grid = projection.CRS["EPSG:2039"]
    dx, dy, dz, rx, ry, rz, ds = grid.to_wgs84
    (a1, i1), (a2, i2) = projection.WGS84, grid.ellipsoid
    e1, e2, n = (2 - 1 / i1) / i1, (2 - 1 / i2) / i2, 1 / (2 * i2 - 1)
    radius = f"({a2!r} / (1 + {n!r}) * (1 + {n!r}^2 / 4 + {n!r}^4 / 64) * {grid.k_0!r})"
    alphas = [
        f"({n!r} / 2 - 2 * {n!r}^2 / 3 + 5 * {n!r}^3 / 16 + 41 * {n!r}^4 / 180)", f"(13 * {n!r}^2 / 48 - 3 * {n!r}^3 / 5 + 557 * {n!r}^4 / 1440)",
        f"(61 * {n!r}^3 / 240 - 103 * {n!r}^4 / 140)", f"(49561 * {n!r}^4 / 161280)",
    ]
    turn = [f"radians({r!r} / 3600)" for r in (rx, ry, rz)]
    phi = "atan2(z, r * (1 - {e}))".format(e=repr(e2))
    steps = "".join(
        f", p{k} AS (SELECT *, atan2(z + {e2!r} * {a2!r} / sqrt(1 - {e2!r} * sin(f{k - 1})^2) * sin(f{k - 1}), r) AS f{k} FROM p{k - 1})" for k in range(1, 6)
    )
    conformal = lambda lat: f"(tan({lat}) * cosh(x) - sqrt(1 + tan({lat})^2) * sinh(x))"
    north = " + ".join(f"{al} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, al in enumerate(alphas, 1))
    east = " + ".join(f"{al} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, al in enumerate(alphas, 1))
    arc = " + ".join(f"{al} * sin({2 * j} * xi0)" for j, al in enumerate(alphas, 1))
    root = math.sqrt(e2)
    lat0, lon0 = f"radians({grid.lat_0!r})", f"radians({grid.lon_0!r})"
    return f"""
    SELECT route_id, seq, round({grid.x_0!r} + {radius} * (eta + {east}), 3) AS x, round({grid.y_0!r} + {radius} * (xi + {north} - xi0 - ({arc})), 3) AS y
    FROM (
      WITH g AS (SELECT route_id, seq, radians(34.5 + (k % 100) * 0.01 + seq * 0.002) AS lam,
                        radians(31.0 + (k // 100 % 100) * 0.01 + ((k * seq) % 3) * 0.0005 + v * 0.00002) AS lat FROM route_vertices),
      c AS (SELECT *, ({a1!r} / sqrt(1 - {e1!r} * sin(lat)^2) * cos(lat) * cos(lam) - {dx!r}) / (1 + {ds!r} * 1e-6) AS x0,
                   ({a1!r} / sqrt(1 - {e1!r} * sin(lat)^2) * cos(lat) * sin(lam) - {dy!r}) / (1 + {ds!r} * 1e-6) AS y0,
                   ({a1!r} / sqrt(1 - {e1!r} * sin(lat)^2) * (1 - {e1!r}) * sin(lat) - {dz!r}) / (1 + {ds!r} * 1e-6) AS z0 FROM g),
      t AS (SELECT route_id, seq, x0 + {turn[2]} * y0 - {turn[1]} * z0 AS xx, y0 - {turn[2]} * x0 + {turn[0]} * z0 AS yy, z0 + {turn[1]} * x0 - {turn[0]} * y0 AS z FROM c),
      p AS (SELECT route_id, seq, z, sqrt(xx^2 + yy^2) AS r, atan2(yy, xx) AS lon FROM t),
      p0 AS (SELECT *, {phi} AS f0 FROM p){steps},
      s AS (SELECT *, {root!r} * atanh({root!r} * sin(f5)) AS x FROM p5),
      s0 AS (SELECT *, {conformal("f5")} AS tau FROM s),
      q AS (SELECT *, {root!r} * atanh({root!r} * sin({lat0})) AS x FROM (SELECT * EXCLUDE (x) FROM s0))
      SELECT *, atan2(tau, cos(lon - {lon0})) AS xi, atanh(sin(lon - {lon0}) / sqrt(1 + tau^2)) AS eta, atan({conformal(lat0)}) AS xi0 FROM q)"""


@query("project_vertices", "route_vertices", _grid_sql(), digits=3)
def project_vertices(v):
    metric = spatial.project(v.geo_routes.select("route_id", "line"), "EPSG:2039")
    return spatial.explode_vertices(metric)


def _parts(v):
    """Lines cut after their second segment; every third link loses the joint, so it stays in parts."""
    cut = v.lines.select(
        "link_id", "k",
        F.posexplode(
            F.array(
                F.slice("line", F.lit(1), F.lit(3)),
                F.slice("line", F.when(F.col("k") % 3 == 0, 4).otherwise(3), F.size("line")),
            )
        ).alias("part", "line"),
    )
    return cut


@query(
    "longest_part",
    "link_segments",
    """SELECT link_id, part, round(sum(len), 6) AS length_m FROM (
         SELECT link_id, CASE WHEN seq < 2 THEN 0 ELSE 1 END AS part, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len
         FROM link_segments WHERE NOT (k % 3 = 0 AND seq = 2))
       GROUP BY link_id, part QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY round(length_m, 9) DESC, part) = 1""",
)
def longest_part(v):
    return spatial.longest_part(_parts(v)).select("link_id", "part", "length_m")


@query(
    "merge_parts",
    "link_segments",
    """SELECT link_id, bool_and(k % 3 <> 0) AS merged,
              round(CASE WHEN bool_and(k % 3 <> 0) THEN sum(len) ELSE sum(len) FILTER (WHERE seq < 2) END, 6) AS length_m
       FROM (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM link_segments) GROUP BY link_id""",
)
def merge_parts(v):
    merged = spatial.merge_parts(_parts(v))
    return merged.select("link_id", "merged", geometry.line_length(F.col("line")).alias("length_m"))


@query(
    "bounds",
    "link_vertices",
    """SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, (min(x) + max(x)) / 2 AS center_x,
              (min(y) + max(y)) / 2 AS center_y FROM link_vertices""",
)
def bounds(v):
    return spatial.bounds(v.lines)


@query(
    "zoom_filter",
    "link_lengths",
    "SELECT link_id, round(length_m, 6) AS length_m FROM link_lengths WHERE length_m >= 1000",
)
def zoom_filter(v):
    return spatial.zoom_filter(v.measured_lines, 3).select("link_id", "length_m")


@query(
    "optimal_zoom",
    "link_vertices",
    """SELECT min_x, min_y, max_x, max_y, CASE WHEN r > 1000 THEN 1 WHEN r > 500 THEN 2 WHEN r > 250 THEN 3 WHEN r > 100 THEN 4
              WHEN r > 50 THEN 5 WHEN r > 25 THEN 6 WHEN r > 10 THEN 7 WHEN r > 5 THEN 8 WHEN r > 2 THEN 9 WHEN r > 1 THEN 10 ELSE 11 END AS zoom_level
       FROM (SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y,
                    greatest((max(x) - min(x)) / 800, (max(y) - min(y)) / 600) AS r FROM link_vertices)""",
)
def optimal_zoom(v):
    return spatial.optimal_zoom(v.lines, 800, 600)


@query(
    "priority_batches",
    "results",
    """SELECT link_id || '|' || date || '|' || hour || '|' || daytype AS cell,
              row_number() OVER (ORDER BY n_total DESC, md5(link_id || '|' || date || '|' || hour || '|' || daytype)) AS position,
              CAST((row_number() OVER (ORDER BY n_total DESC, md5(link_id || '|' || date || '|' || hour || '|' || daytype)) - 1) // 1000 AS INT) AS batch
       FROM results""",
)
def priority_batches(v):
    cells = v.results.select(F.concat_ws("|", "link_id", "date", "hour", "daytype").alias("cell"), "n_total")
    return spatial.priority_batches(cells, 1000, "n_total", "cell").select("cell", "position", "batch")
