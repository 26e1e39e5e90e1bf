"""Whole runs over small files, and the stream against the batch."""

import glob
import json
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from linkspark.config import AggregationParams, CompletenessParams, ValidationParams
from linkspark.operators import quality, rollup
from linkspark.plans import aggregation, azimuth, control, maps
from linkspark.streaming import rollup as stream
from linkspark.workload.encoding import encode
from linkspark.workload.views import Views

LINE = "array<struct<x: double, y: double>>"
SMALL = "/root/testdata/sf0.001"
HEADER = "DataID,Name,SegmentID,RouteAlternative,RequestedTime,Timestamp,DayInWeek,DayType,Duration (seconds),Distance (meters),Speed (km/h),Url,Polyline,is_valid"


def test_aggregation_run(spark, folder):
    start = datetime(2025, 7, 1)
    lines = [HEADER]
    for i in range(96):
        ts = start + timedelta(minutes=15 * i)
        ok = "FALSE" if i % 4 == 3 else "TRUE"
        lines.append(f"{i},s_1-2,1,1,{ts:%H:%M:%S},{ts:%d/%m/%Y %H:%M},יום ג,יום חול,{100 + i},500,40,u,p,{ok}")
    lines.append(lines[1])  # repeated DataID
    with open(f"{folder}/raw.csv", "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    with open(f"{folder}/days.txt", "w") as f:
        f.write("2025-07-02 Other\n")
    params = AggregationParams(min_valid_per_hour=3, write_parquet=True, hours_include=tuple(range(24)))
    out = aggregation.run(spark, f"{folder}/raw.csv", f"{folder}/out", params, custom_holidays=f"{folder}/days.txt")
    hourly = spark.read.parquet(out["hourly"])
    assert hourly.count() == 24
    assert hourly.agg(F.sum("n_total"), F.sum("n_valid")).first()[:] == (96, 72)
    first = hourly.where("hour_of_day = 0").first()
    assert first.avg_duration_sec == 101.0 and first.daytype == "weekday" and first.valid_hour
    summary = json.loads("".join(open(p).read() for p in glob.glob(f"{out['run_summary']}/*.json")))
    assert (summary["raw_rows"], summary["hourly_rows"], summary["weekly_rows"], summary["n_valid_median"]) == (96, 24, 24, 3.0)
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{out['hourly_csv']}/*.csv")))
    assert "s_1-2,2025-07-01,0,weekday,4,3,true,0,101.000000,1.000000,500.000000,40.000000" in text
    assert spark.read.parquet(out["weekly"]).count() == 24
    log = spark.read.option("header", True).csv(out["performance"]).orderBy(F.col("position").cast("int")).collect()
    assert [r.step for r in log][:3] == ["observations", "hourly", "weekly"] and log[-1].step == "total"
    assert log[0].rows == "97" and float(log[-1].seconds) > 0
    ingest = spark.read.json(out["ingest"]).first()
    assert (ingest.rows_read, ingest.unparsed_timestamps) == (97, 0)


def test_mixed_timestamps_are_kept(spark, folder):
    # two layouts of one link, and text that is no time
    start = datetime(2025, 7, 1)
    times = [start + timedelta(minutes=i) for i in range(200)]
    text = [f"{t:%Y-%m-%d %H:%M:%S}" if i < 120 else t.isoformat() for i, t in enumerate(times)] + ["noon", "soon", "soon"]
    rows = [(i, "s_1-2", t, 100.0 if i % 2 else -5.0, 500.0, 40.0) for i, t in enumerate(text)]
    raw = spark.createDataFrame(rows, "data_id long, name string, timestamp string, duration double, distance double, speed double")
    params = AggregationParams(timestamp_format="yyyy-MM-dd HH:mm:ss", timezone="UTC", remove_link_timestamp_duplicates=True)
    done = aggregation.prepare(raw, params)
    assert done.where("timestamp IS NOT NULL").count() == 200
    assert sorted(r._unresolved for r in done.where("timestamp IS NULL").collect()) == ["noon", "soon"]
    raw.selectExpr("data_id AS DataID", "name AS Name", "timestamp AS Timestamp", "duration AS `Duration (seconds)`", "distance AS `Distance (meters)`", "speed AS `Speed (km/h)`", "1 AS SegmentID", "1 AS RouteAlternative", "'x' AS RequestedTime", "'x' AS DayInWeek", "'x' AS DayType", "'u' AS Url", "'p' AS Polyline") \
        .coalesce(1).write.option("header", True).csv(f"{folder}/raw")
    out = aggregation.run(spark, f"{folder}/raw", f"{folder}/out", params)
    ingest = spark.read.json(out["ingest"]).first()
    assert (ingest.rows_read, ingest.unparsed_timestamps) == (203, 3)
    reasons = {r.invalid_reason: int(r["count"]) for r in spark.read.option("header", True).csv(out["invalid_reasons"]).collect()}
    assert reasons["duration_out_of_range"] == 102 and reasons["speed_out_of_range"] == 0
    assert spark.read.option("header", True).csv(out["unresolved"]).count() == 3


def test_control_run(spark, folder):
    net = spark.createDataFrame(
        [("1", "1", "2", "s_1-2", [(34.80, 32.00), (34.81, 32.005)]), ("2", "2", "3", "s_2-3", [(34.81, 32.005), (34.82, 32.0)])],
        f"Id string, from_id string, to_id string, link_id string, line {LINE}",
    )
    good, bad = (
        spark.createDataFrame([(points,)], f"line {LINE}").select(encode(F.col("line")).alias("e")).first().e
        for points in ([(34.80, 32.00), (34.81, 32.005)], [(34.80, 32.01), (34.81, 32.02)])
    )
    slots = [datetime(2025, 7, 1) + timedelta(minutes=15 * i) for i in range(94)]
    rows = [(i, "s_1-2", s, s.strftime("%H:%M:%S"), 1, bad if i == 5 else good, "יום ג") for i, s in enumerate(slots)]
    obs = spark.createDataFrame(
        rows, "data_id long, name string, timestamp timestamp_ntz, requested_time string, route_alternative int, polyline string, day_in_week string"
    )
    schedule = CompletenessParams(date(2025, 7, 1), date(2025, 7, 1), 15)
    out = control.run(spark, obs, net, f"{folder}/out", ValidationParams(), schedule)

    def read(name):
        return spark.read.option("header", True).csv(out[name])

    assert read("validated_csv").count() == 94 and read("best_valid_csv").count() == 93
    failed = read("failed_csv").first()
    assert failed.failure_reason.startswith("Hausdorff: ") and failed.valid_code == "2"
    assert read("missing_csv").count() == 2 and [r[0] for r in read("no_data_csv").select("link_id").collect()] == ["s_2-3"]
    report = {r["From"]: r for r in read("link_report_csv").collect()}
    assert (report["1"].total_observations, report["1"].failed_observations, report["1"].missing_observations) == ("94", "1", "2")
    assert report["2"].perfect_match_percent is None
    features = [json.loads(r.value) for r in spark.read.text(out["failed_routes_layer"]).collect()]
    assert len(features) == 1 and features[0]["geometry"]["coordinates"][0] == [34.8, 32.01]
    assert spark.read.text(out["failed_layer"]).count() == 1
    layer = [json.loads(r.value) for r in spark.read.text(out["link_report_layer"]).collect()]
    assert {f["properties"]["link_id"] for f in layer} == {"s_1-2", "s_2-3"}


def test_azimuth_run(spark, folder):
    net = spark.createDataFrame([("7", [(34.80, 32.00), (34.81, 32.0)]), ("8", [(1.0, 1.0)])], f"link_id string, line {LINE}")
    out = azimuth.run(net, f"{folder}/azimuth")
    assert [r.Id for r in spark.read.parquet(out["azimuths"]).collect()] == ["7-73"]
    assert spark.read.option("header", True).csv(out["requests"]).first().mode == "0"


def test_rendering(spark):
    v = Views(spark, SMALL)
    shown = maps.for_rendering(v.lines, 3, (0, -100, 5000, 200), 2)
    assert shown.count() == v.lines.count() or shown.count() > 0
    assert {r.batch for r in shown.collect()} == {(r.position - 1) // 2 for r in shown.collect()}


def test_stream_matches_batch(spark, folder):
    rows = [
        (i, f"s_{i % 3}-1", datetime(2025, 7, 1) + timedelta(minutes=7 * i), 100.0 + i % 13, 40.0, i % 5 != 0) for i in range(400)
    ]
    df = spark.createDataFrame(rows, "data_id long, name string, ts timestamp, duration double, speed double, is_valid boolean")
    df.unionByName(df.where("data_id % 2 = 0")).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    once = source.withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark(["data_id"])
    stream.run_available(stream.hourly(once, delay=None), f"{folder}/out", f"{folder}/check")
    got = {(r.link_id, r.date, r.hour_of_day): r for r in spark.read.parquet(f"{folder}/out").collect()}
    batch = df.withColumns({"date": F.to_date("ts"), "hour_of_day": F.hour("ts"), "daytype": F.lit("x")})
    want = {(r.link_id, r.date, r.hour_of_day): r for r in rollup.hourly_aggregation(batch).collect()}
    assert len(got) >= len(want) - 12 and set(got) <= set(want)
    for key, row in got.items():
        assert (row.n_total, row.n_valid) == (want[key].n_total, want[key].n_valid)
        assert (row.avg_duration_sec is None) == (want[key].avg_duration_sec is None)
        if row.avg_duration_sec is not None:
            assert abs(row.avg_duration_sec - want[key].avg_duration_sec) < 1e-9
    # a second run over the same checkpoint adds nothing
    stream.run_available(stream.hourly(source.withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark(["data_id"]), delay=None), f"{folder}/out", f"{folder}/check")
    assert spark.read.parquet(f"{folder}/out").count() == len(got)


def test_quality_of_empty_and_bad_data(spark):
    schema = "link_id string, date date, hour int, avg_duration_sec double, avg_speed_kmh double, n_valid long"
    empty = spark.createDataFrame([], schema)
    assert quality.speed_quality(empty).first().quality_score is None
    rows = [("s_1-2", date(2025, 1, 1), h, d, s, n) for h, d, s, n in ((1, 0.0, 0.0, 1), (2, 4000.0, 200.0, 2), (3, 60.0, 50.0, 20), (4, None, None, 0))]
    bad = spark.createDataFrame(rows, schema)
    speed, duration, obs = (f(bad).first() for f in (quality.speed_quality, quality.duration_quality, quality.observation_quality))
    assert (speed.non_positive, speed.extreme_high, speed.out_of_range, speed.null_count) == (1, 1, 1, 1)
    assert round(speed.quality_score, 6) == round(100 - 200 / 3, 6) and speed.quality_level == "poor"
    assert (duration.non_positive, duration.extreme_long) == (1, 1)
    assert (obs.critical, obs.sparse, obs.unreliable, obs.quality_score) == (1, 2, 3, 25.0)
