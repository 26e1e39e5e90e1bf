"""The domain's tables as views of the given tables, once for Spark and once as SQL.

Every view is a mapping of whole tables: ``events`` are observations, ``supplier`` gives the reference
network (four suppliers share a link), ``lineitem`` is the large observation table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.config import AggregationParams
from linkspark.functions import text
from linkspark.functions.temporal import floor_to_interval
from linkspark.operators import rollup, spatial, temporal
from linkspark.workload.encoding import encode

# letters of Monday .. Sunday
DAY_LETTERS = ["ב", "ג", "ד", "ה", "ו", "ש", "א"]
ROUTE_OFFSETS = [0, 2, 4, 8]

LINK_ID = "'s_' || k || '-' || (k + 100)"

CTES = {
    "ev": """
        SELECT *, user_id // 5 + 2 AS k, CAST(event_id % 4 AS INT) AS v, CAST(isodow(ts) - 1 AS INT) AS wd,
               time_bucket(INTERVAL '15 minutes', ts) AS slot
        FROM events""",
    "obs": f"""
        SELECT event_id AS data_id, {LINK_ID} AS name, ts, slot AS "timestamp",
               strftime(slot, '%H:%M:%S') AS requested_time, CAST(1 + event_id % 3 AS INT) AS route_alternative,
               30 + 10 * value AS duration, 0.9 * (30 + 10 * value) AS static_duration,
               CAST(500 + 400 * (k % 40) AS DOUBLE) AS distance,
               CAST(500 + 400 * (k % 40) AS DOUBLE) / (30 + 10 * value) * 3.6 AS speed,
               event_type <> 'error' AS is_valid, event_type AS valid_code,
               'p' || k || '_' || v AS polyline, k, v,
               CASE WHEN event_id % 11 = 0 THEN NULL
                    ELSE CASE wd WHEN 0 THEN 'ב' WHEN 1 THEN 'ג' WHEN 2 THEN 'ד' WHEN 3 THEN 'ה' WHEN 4 THEN 'ו'
                                 WHEN 5 THEN 'ש' ELSE 'א' END END AS day_in_week,
               CASE WHEN event_id % 97 = 0 THEN 'חג' WHEN event_id % 5 = 0 THEN 'other'
                    WHEN wd < 5 THEN 'workday' ELSE 'weekend' END AS day_type
        FROM {{ev}}""",
    "obs_dup": """
        SELECT *, 0 AS delivery FROM {obs}
        UNION ALL SELECT *, 1 AS delivery FROM {obs} WHERE valid_code IN ('purchase', 'view')""",
    "links": f"""
        SELECT {LINK_ID} AS link_id, k AS from_id, k + 100 AS to_id, k
        FROM (SELECT DISTINCT s_suppkey // 4 AS k FROM supplier)""",
    "link_vertices": """
        SELECT link_id, k, CAST(seq AS INT) AS seq, CAST(1000 * k + 200 * seq AS DOUBLE) AS x,
               CAST(50 * ((k * seq) % 3) AS DOUBLE) AS y
        FROM {links}, range(0, 6) AS r(seq) WHERE seq < 4 + k % 3""",
    "routes": """
        SELECT DISTINCT polyline AS route_id, name AS link_id, k, v FROM {obs}""",
    "route_vertices": """
        SELECT route_id, link_id, k, v, CAST(seq AS INT) AS seq, CAST(1000 * k + 200 * seq AS DOUBLE) AS x,
               CAST(50 * ((k * seq) % 3) + CASE v WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS DOUBLE) AS y
        FROM {routes}, range(0, 6) AS r(seq) WHERE seq < 4 + k % 3""",
    "link_segments": """
        SELECT * FROM (
            SELECT link_id, k, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
            FROM {link_vertices} WINDOW w AS (PARTITION BY link_id ORDER BY seq)) WHERE x2 IS NOT NULL""",
    "route_segments": """
        SELECT * FROM (
            SELECT route_id, link_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
            FROM {route_vertices} WINDOW w AS (PARTITION BY route_id ORDER BY seq)) WHERE x2 IS NOT NULL""",
    "link_lengths": """
        SELECT link_id, k, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS length_m
        FROM {link_segments} GROUP BY link_id, k""",
    "vertex_distance": """
        SELECT pair, side, link_id, seq, min(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2)) AS d
        FROM (SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))
                                       / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t
              FROM (SELECT p.route_id AS pair, 'route' AS side, p.link_id, p.seq, x, y, x1, y1, x2, y2
                    FROM {route_vertices} p JOIN {link_segments} s ON p.link_id = s.link_id
                    UNION ALL
                    SELECT s.route_id, 'link', p.link_id, p.seq, x, y, x1, y1, x2, y2
                    FROM {link_vertices} p JOIN {route_segments} s ON p.link_id = s.link_id))
        GROUP BY pair, side, link_id, seq""",
    "pair_distance": """
        SELECT pair AS route_id, link_id, max(d) AS hausdorff_distance FROM {vertex_distance} GROUP BY pair, link_id""",
    "checked": """
        SELECT o.*, CASE o.v WHEN 0 THEN 0.0 WHEN 1 THEN 2.0 WHEN 2 THEN 4.0 ELSE 8.0 END AS hausdorff_distance,
               o.v < 3 AS hausdorff_pass, 1.0 + o.v * 0.05 AS length_ratio, o.v < 3 AS length_pass,
               100.0 - o.v * 10 AS coverage_percent, o.v < 2 AS coverage_pass,
               CASE WHEN l.link_id IS NULL THEN 92 WHEN count(*) OVER (PARTITION BY name, "timestamp") = 1 THEN 2
                    ELSE 3 END AS code,
               l.link_id IS NOT NULL AND o.is_valid AND o.v < 3 AS ok
        FROM {obs} o LEFT JOIN {links} l ON o.name = l.link_id""",
    "calendar": """
        SELECT date, CASE WHEN day(date) IN (15, 20) THEN 'Custom ' ELSE 'National ' END || date AS name
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) WHERE day(date) IN (1, 15, 20)""",
    "timed": """
        SELECT *, CAST("timestamp" AS DATE) AS date, CAST(hour("timestamp") AS INT) AS hour_of_day,
               CAST(weekofyear("timestamp") AS INT) AS iso_week, CAST(isodow("timestamp") - 1 AS INT) AS weekday_index
        FROM {obs}""",
    "enh": """
        SELECT t.* EXCLUDE (weekday_index), weekday_index, c.date IS NOT NULL AS is_holiday,
               coalesce(c.name, '') AS holiday_name,
               CASE WHEN c.date IS NOT NULL THEN 'holiday' WHEN day_type = 'חג' THEN 'holiday'
                    WHEN day_type = 'workday' THEN 'weekday' WHEN day_type = 'weekend' THEN 'weekend'
                    WHEN weekday_index < 5 THEN 'weekday' ELSE 'weekend' END AS daytype
        FROM {timed} t LEFT JOIN {calendar} c ON t.date = c.date""",
    "hourly": """
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
        FROM {enh} GROUP BY name, date, hour_of_day, daytype""",
    "weekly": """
        SELECT link_id, daytype, hour_of_day, avg(n_valid) AS avg_n_valid,
               CAST(sum(n_valid) AS BIGINT) AS total_valid_n, CAST(sum(n_total - n_valid) AS BIGINT) AS total_not_valid,
               avg(avg_duration_sec) AS avg_dur, avg(std_duration_sec) AS std_dur,
               avg(avg_static_duration_sec) AS avg_static_dur, avg(std_static_duration_sec) AS std_static_dur,
               avg(avg_distance_m) AS avg_dist, avg(avg_speed_kmh) AS avg_speed, count(DISTINCT date) AS n_days
        FROM {hourly} WHERE valid_hour GROUP BY link_id, daytype, hour_of_day""",
    "results": """
        SELECT link_id, date, hour_of_day AS hour, daytype, n_total, n_valid, avg_duration_sec, avg_speed_kmh
        FROM {hourly}""",
    "map_base": """
        SELECT r.*, l.length_m FROM {results} r JOIN {link_lengths} l ON r.link_id = l.link_id""",
    "big": """
        SELECT 's_' || l_suppkey || '-' || (l_suppkey + 100) AS name, l_orderkey * 8 + l_linenumber AS data_id,
               CAST(l_shipdate AS DATE) AS date, CAST(l_orderkey % 24 AS INT) AS hour_of_day,
               CASE WHEN isodow(l_shipdate) < 6 THEN 'weekday' ELSE 'weekend' END AS daytype,
               l_extendedprice / 97 AS duration, l_extendedprice / 97 * 0.9 AS static_duration,
               l_quantity * 100 AS distance, l_quantity * 100 / (l_extendedprice / 97) * 3.6 AS speed,
               l_returnflag <> 'R' AS is_valid
        FROM lineitem""",
}


class Views:
    """Spark form of the views for one table folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        letters = ", ".join(f"'{c}'" for c in DAY_LETTERS)
        ev = self.table("events").selectExpr(
            "*", "user_id div 5 + 2 AS k", "CAST(event_id % 4 AS INT) AS v", "weekday(ts) AS wd",
        ).withColumn("slot", floor_to_interval(F.col("ts"), 15))
        return ev.selectExpr(
            "event_id AS data_id",
            "concat('s_', k, '-', k + 100) AS name",
            "ts",
            "slot AS timestamp",
            "date_format(slot, 'HH:mm:ss') AS requested_time",
            "CAST(1 + event_id % 3 AS INT) AS route_alternative",
            "30 + 10 * value AS duration",
            "CAST(0.9 AS DOUBLE) * (30 + 10 * value) AS static_duration",
            "CAST(500 + 400 * (k % 40) AS DOUBLE) AS distance",
            "CAST(500 + 400 * (k % 40) AS DOUBLE) / (30 + 10 * value) * CAST(3.6 AS DOUBLE) AS speed",
            "event_type <> 'error' AS is_valid",
            "event_type AS valid_code",
            "concat('p', k, '_', v) AS polyline",
            "k",
            "v",
            f"CASE WHEN event_id % 11 = 0 THEN NULL ELSE element_at(array({letters}), wd + 1) END AS day_in_week",
            "CASE WHEN event_id % 97 = 0 THEN 'חג' WHEN event_id % 5 = 0 THEN 'other' "
            "WHEN wd < 5 THEN 'workday' ELSE 'weekend' END AS day_type",
        )

    @cached_property
    def obs_dup(self) -> DataFrame:
        """Observations with every purchase and view delivered twice."""
        again = self.obs.where("valid_code IN ('purchase', 'view')").withColumn("delivery", F.lit(1))
        return self.obs.withColumn("delivery", F.lit(0)).unionByName(again)

    @cached_property
    def links(self) -> DataFrame:
        keys = self.table("supplier").selectExpr("s_suppkey div 4 AS k").distinct()
        return keys.select(
            text.link_key(F.col("k"), F.col("k") + 100).alias("link_id"),
            F.col("k").alias("from_id"),
            (F.col("k") + 100).alias("to_id"),
            "k",
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Network with metric lines."""
        points = F.transform(
            F.sequence(F.lit(0).cast("bigint"), 3 + F.col("k") % 3),
            lambda s: F.struct(
                (1000 * F.col("k") + 200 * s).cast("double").alias("x"),
                (50 * ((F.col("k") * s) % 3)).cast("double").alias("y"),
            ),
        )
        return self.links.withColumn("line", points)

    @cached_property
    def measured_lines(self) -> DataFrame:
        return spatial.with_length(self.lines)

    @cached_property
    def routes(self) -> DataFrame:
        """Distinct observed routes with metric lines: the link's line moved north by 0, 2, 4 or 8 m."""
        keys = self.obs.select(F.col("polyline").alias("route_id"), F.col("name").alias("link_id"), "k", "v").distinct()
        offset = F.element_at(F.array(*[F.lit(o) for o in ROUTE_OFFSETS]), F.col("v") + 1)
        points = F.transform(
            F.sequence(F.lit(0).cast("bigint"), 3 + F.col("k") % 3),
            lambda s: F.struct(
                (1000 * F.col("k") + 200 * s).cast("double").alias("x"),
                (50 * ((F.col("k") * s) % 3) + offset).cast("double").alias("y"),
            ),
        )
        return keys.withColumn("line", points)

    @cached_property
    def geo_routes(self) -> DataFrame:
        """Distinct observed routes with lines in degrees and their encoded text."""
        k, v = F.col("k"), F.col("v")
        points = F.transform(
            F.sequence(F.lit(0).cast("bigint"), 3 + k % 3),
            lambda s: F.struct(
                (34.5 + (k % 100) * 0.01 + s * 0.002).alias("x"),
                (31.0 + (F.floor(k / 100) % 100) * 0.01 + ((k * s) % 3) * 0.0005 + v * 0.00002).alias("y"),
            ),
        )
        keyed = self.routes.drop("line").withColumn("line", points)
        return keyed.withColumn("polyline", encode(F.col("line")))

    @cached_property
    def checked(self) -> DataFrame:
        """Observations with given test results, as a validation run leaves them."""
        known = self.links.select(F.col("link_id").alias("ref"))
        counts = self.obs.groupBy("name", "timestamp").agg(F.count("*").alias("alts"))
        joined = self.obs.join(known, F.col("name") == F.col("ref"), "left").join(counts, ["name", "timestamp"])
        return joined.selectExpr(
            "* EXCEPT (ref, alts, is_valid, valid_code)",
            "CAST(element_at(array(0, 2, 4, 8), v + 1) AS DOUBLE) AS hausdorff_distance",
            "v < 3 AS hausdorff_pass",
            "CAST(1.0 AS DOUBLE) + v * CAST(0.05 AS DOUBLE) AS length_ratio",
            "v < 3 AS length_pass",
            "CAST(100 - v * 10 AS DOUBLE) AS coverage_percent",
            "v < 2 AS coverage_pass",
            "CASE WHEN ref IS NULL THEN 92 WHEN alts = 1 THEN 2 ELSE 3 END AS valid_code",
            "ref IS NOT NULL AND is_valid AND v < 3 AS is_valid",
        )

    @cached_property
    def calendars(self) -> tuple[DataFrame, DataFrame]:
        """National and custom holidays on days of the data; both have the fifteenth."""
        days = self.table("events").select(F.to_date("ts").alias("date")).distinct()

        def named(prefix: str, *of_month: int) -> DataFrame:
            return days.where(F.dayofmonth("date").isin(*of_month)).select(
                "date", F.concat(F.lit(prefix), F.col("date").cast("string")).alias("name")
            )

        return named("National ", 1, 15), named("Custom ", 15, 20)

    @cached_property
    def calendar(self) -> DataFrame:
        return temporal.holiday_calendar(*self.calendars)

    @cached_property
    def enhanced(self) -> DataFrame:
        return temporal.enhance(self.obs, AggregationParams(), self.calendar)

    @cached_property
    def hourly(self) -> DataFrame:
        return rollup.hourly_aggregation(self.enhanced)

    @cached_property
    def weekly(self) -> DataFrame:
        return rollup.weekly_profile(self.hourly)

    @cached_property
    def results(self) -> DataFrame:
        """Hourly rollup under map names."""
        return rollup.to_map_columns(self.hourly).select(
            "link_id", "date", "hour", "daytype", "n_total", "n_valid", "avg_duration_sec", "avg_speed_kmh"
        )

    @cached_property
    def map_base(self) -> DataFrame:
        """Results of network links with the link length."""
        return self.results.join(self.measured_lines.select("link_id", "length_m"), "link_id")

    @cached_property
    def big(self) -> DataFrame:
        """Prepared observations from the large table."""
        return self.table("lineitem").selectExpr(
            "concat('s_', l_suppkey, '-', l_suppkey + 100) AS name",
            "l_orderkey * 8 + l_linenumber AS data_id",
            "to_date(l_shipdate) AS date",
            "CAST(l_orderkey % 24 AS INT) AS hour_of_day",
            "CASE WHEN weekday(l_shipdate) < 5 THEN 'weekday' ELSE 'weekend' END AS daytype",
            "l_extendedprice / 97 AS duration",
            "l_extendedprice / 97 * CAST(0.9 AS DOUBLE) AS static_duration",
            "l_quantity * 100 AS distance",
            "l_quantity * 100 / (l_extendedprice / 97) * CAST(3.6 AS DOUBLE) AS speed",
            "l_returnflag <> 'R' AS is_valid",
        )
