from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkspark.config import CompletenessParams, ValidationParams
from linkspark.operators import control, spatial
from linkspark.operators.grouping import lookup_join
from linkspark.workload.encoding import encode

METRIC = ValidationParams(crs_metric=None)
LINE = "array<struct<x: double, y: double>>"


def network(spark, *pairs):
    rows = [(f"s_{a}-{b}", a, b) for a, b in pairs]
    return spark.createDataFrame(rows, "link_id string, from_id string, to_id string")


def checked(spark, rows):
    return spark.createDataFrame(
        rows, "data_id long, link_id string, timestamp timestamp_ntz, polyline string, route_alternative int, is_valid boolean, valid_code int"
    )


def at(hour, minute=0, day=1):
    return datetime(2025, 7, day, hour, minute)


def test_link_report_codes(spark):
    rows = [
        (1, "s_653-655", at(10), "a", 1, True, 2), (2, "s_653-655", at(11), "b", 1, False, 2),
        (3, "s_655-657", at(10), "c", 2, True, 3), (4, "s_655-657", at(11), "d", 2, True, 3),
    ]
    links = network(spark, ("653", "655"), ("655", "657"), ("999", "888"))
    report = {r.link_id: r for r in control.link_report(checked(spark, rows), links, ["data_id"]).collect()}
    assert len(report) == 3
    assert report["s_653-655"].result_code == 21 and report["s_653-655"].num == 50.0
    assert report["s_655-657"].result_code == 30 and report["s_655-657"].num == 100.0
    empty = report["s_999-888"]
    assert (empty.result_code, empty.result_label, empty.num, empty.total_observations) == (41, "did not record", None, 0)
    assert empty.perfect_match_percent is None


@pytest.mark.parametrize(
    "flags, alternative, code",
    [((True, True), 1, 0), ((True, False), 1, 21), ((False, False), 1, 22), ((True, True), 2, 30), ((True, False), 2, 31), ((False, False), 2, 32)],
)
def test_result_codes(spark, flags, alternative, code):
    rows = [(i, "s_1-2", at(i), f"p{i}", alternative, ok, 2) for i, ok in enumerate(flags)]
    stats = control.with_result_code(control.link_statistics(checked(spark, rows)))
    assert stats.first().result_code == code


def test_report_deduplicates_and_includes_the_last_day(spark):
    rows = [
        (1, "s_1-2", at(10), "a", 1, True, 2), (2, "s_1-2", at(10), "a", 1, True, 2),
        (3, "s_1-2", at(23, 45, 2), "a", 1, False, 2), (4, "s_1-2", at(0, 0, 3), "a", 1, True, 2),
    ]
    links = network(spark, ("1", "2"))
    schedule = CompletenessParams(date(2025, 7, 1), date(2025, 7, 2), 15)
    row = control.link_report(
        checked(spark, rows), links, ["data_id"], schedule, start_date="2025-07-01", end_date="2025-07-02"
    ).first()
    assert (row.total_observations, row.total_routes, row.successful_observations) == (2, 2, 1)
    assert (row.expected_observations, row.missing_observations) == (192, 190)


def test_best_failed_and_unique(spark):
    base = checked(
        spark,
        [
            (1, "s_1-2", at(1), "a", 1, True, 3), (2, "s_1-2", at(1), "b", 2, True, 3),
            (3, "s_1-2", at(2), "a", 1, False, 3), (4, "s_1-2", at(2), "b", 2, True, 3),
            (5, "s_1-2", at(3), "a", 1, False, 3), (6, "s_1-2", at(3), "b", 2, False, 3), (7, "s_1-2", at(4), "a", 1, False, 90),
            (8, "s_1-2", at(5), "a", 1, False, 2),
        ],
    ).withColumn("hausdorff_distance", F.expr("CASE data_id WHEN 1 THEN 4.0D WHEN 2 THEN 1.0D ELSE 2.0D END"))
    assert {r.data_id for r in control.best_valid(base, ["data_id"]).collect()} == {2, 4}
    assert {r.data_id for r in control.failed_observations(base).collect()} == {5, 6, 7, 8}
    failed = control.failed_geometry(base)
    assert {r.data_id for r in failed.collect()} == {5, 6, 8}
    assert {r.data_id for r in control.unique_routes(failed, ["data_id"]).collect()} == {5, 6}


def test_hot_groups_give_the_same_result(spark):
    rows = spark.range(3000).selectExpr(
        "id AS data_id", "CASE WHEN id < 1000 THEN 's_0-0' ELSE concat('s_', id % 500, '-1') END AS name",
        "CASE WHEN id < 1000 THEN timestamp_ntz'2025-07-01 00:00:00' ELSE timestamp_ntz'2025-07-01 00:00:00' + make_interval(0,0,0,0,0,CAST(id % 3 AS INT)) END AS timestamp",
        "id % 4 = 0 AND id >= 1000 AS is_valid",
    ).repartition(6)
    plain = {r.data_id: r.n_alternatives for r in control.alternatives(rows).collect()}
    hot = {r.data_id: r.n_alternatives for r in control.alternatives(rows, hot_rows=10).collect()}
    assert plain == hot and plain[5] == 1000
    a = {r.data_id for r in control.failed_observations(rows).collect()}
    assert a == {r.data_id for r in control.failed_observations(rows, hot_rows=5).collect()} and set(range(1000)) <= a


def test_hot_lookups_are_spread_by_the_salt(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id < 600 THEN 1 ELSE id END AS k", "id").repartition(4)
    lookup = df.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    joined = lookup_join(df, lookup, ["k"], "n", hot_rows=100)
    assert all(r.v == r.k * 10 for r in joined.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookup_join(df, lookup, ["k"], "n", hot_rows=100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line]
    assert sum("__salt" in line for line in exchanges) == 2


def lines(spark):
    rows = [("s_11430-1321", [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]), ("s_1-2", [(0.0, 1.0), (0.0, 3.0)])]
    return spark.createDataFrame(rows, f"link_id string, line {LINE}")


def encoded(spark, points):
    df = spark.createDataFrame([(points,)], f"line {LINE}")
    return df.select(encode(F.col("line")).alias("e")).first().e


OBS = "data_id long, name string, timestamp timestamp_ntz, route_alternative int, polyline string"


def test_validation_cases(spark):
    good = encoded(spark, [(0.0, 0.0), (2.0, 0.0)])
    far = encoded(spark, [(0.0, 7.0), (2.0, 7.0)])
    rows = [
        (1, "s_11430-1321", at(1), 1, good),  # single, passes
        (2, "s_11430-1321", at(2), 1, good), (3, " 11430_1321 ", at(2), 2, far),  # other spelling: own group
        (4, "s_11430-1321", at(3), 1, good), (5, "s_11430-1321", at(3), 2, far),  # two alternatives, one fails
        (6, "s_11430-1321", None, 1, good), (7, "s_11430-1321", at(4), None, good), (8, "s_11430-1321", at(5), 1, None),
        (9, "no link", at(6), 1, good), (10, "s_7-8", at(7), 1, good), (11, "s_11430-1321", at(8), 1, "INVALID_POLYLINE"),
        (12, "S-11430-1321", at(9), 1, far),
    ]
    df = spark.createDataFrame(rows, OBS)
    for hot_rows in (1_000_000, 1):
        out = {r.data_id: r for r in control.validate(df, lines(spark), METRIC, hot_rows).collect()}
        codes = {i: out[i].valid_code for i in out}
        assert codes == {1: 2, 2: 2, 3: 2, 4: 3, 5: 3, 6: 90, 7: 90, 8: 90, 9: 91, 10: 92, 11: 93, 12: 2}
        assert [i for i in out if out[i].is_valid] and {i for i in out if out[i].is_valid} == {1, 2, 4}
        assert out[1].hausdorff_distance == 0.0 and out[5].hausdorff_distance == pytest.approx(7.0)
        assert out[9].hausdorff_distance is None and out[9].hausdorff_pass is None
        assert out[6].hausdorff_pass is False
    geometry_only = control.validate(df.drop("route_alternative"), lines(spark), METRIC)
    codes = {r.data_id: r.valid_code for r in geometry_only.collect()}
    assert codes == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 90, 9: 91, 10: 92, 11: 93, 12: 1}


def test_observation_geometry_with_hot_and_null_routes(spark):
    good = encoded(spark, [(0.0, 0.0), (2.0, 0.0)])
    rows = [(i, "s_1-2", at(1), 1, good if i % 3 else (None if i % 2 else "bad~")) for i in range(60)]
    rows.append((99, "s_9-9", at(1), 1, None))
    df = spark.createDataFrame(rows, OBS).repartition(4)
    for hot_rows in (1_000_000, 5):
        out = {r.data_id: r for r in spatial.observation_geometry(df, lines(spark), hot_rows=hot_rows).collect()}
        assert set(out) == set(range(60))
        assert all(out[i].geometry_source == ("route" if i % 3 else "reference") for i in out)


def test_all_three_tests(spark):
    params = ValidationParams(
        use_length_check=True, use_coverage_check=True, crs_metric=None, min_link_length_m=0.5, coverage_spacing_m=0.1
    )
    half = encoded(spark, [(0.0, 0.0), (1.0, 0.0)])
    df = spark.createDataFrame([(1, "s_11430-1321", at(1), 1, half)], OBS)
    row = control.validate(df, lines(spark), params).first()
    assert row.hausdorff_pass and not row.length_pass and not row.coverage_pass and not row.is_valid
    assert row.length_ratio == pytest.approx(0.5) and row.coverage_percent == pytest.approx(50.0)
    text = control.validate(df, lines(spark), params)
    assert text.select(control.failure_reason(text).alias("r")).first().r == "Length: 0.50x; Coverage: 50.0%"


def test_real_coordinates(spark):
    """Routes and network in degrees, judged in metres."""
    from linkspark.plans.control import metric_links

    reference = [(34.80, 32.00), (34.81, 32.005)]
    shifted = [(x, y + 0.0001) for x, y in reference]  # about 11 m north
    net = spark.createDataFrame([("s_1-2", reference)], f"link_id string, line {LINE}")
    rows = [(1, "s_1-2", at(1), 1, encoded(spark, reference)), (2, "s_1-2", at(2), 1, encoded(spark, shifted))]
    out = {r.data_id: r for r in control.validate(spark.createDataFrame(rows, OBS), metric_links(net, ValidationParams())).collect()}
    assert out[1].hausdorff_distance < 0.01 and out[1].is_valid
    assert out[2].hausdorff_distance == pytest.approx(11.1, abs=0.3) and not out[2].is_valid


def test_missing_observations(spark):
    slots = [datetime(2025, 7, 1) + timedelta(minutes=15 * i) for i in range(4 * 96)]
    rows = [("s_1-2", s, s.strftime("%H:%M:%S")) for s in slots]
    schedule = CompletenessParams(date(2025, 7, 1), date(2025, 7, 4), 15)
    schema = "link_id string, timestamp timestamp_ntz, requested_time string"
    full = spark.createDataFrame(rows, schema)
    assert control.missing_observations(full, schedule).count() == 0
    part = control.missing_observations(spark.createDataFrame(rows[:-3], schema), schedule).collect()
    assert [(r.date, r.requested_time, r.valid_code) for r in sorted(part, key=lambda r: r.requested_time)] == [
        (date(2025, 7, 4), t, 94) for t in ("23:15:00", "23:30:00", "23:45:00")
    ]


def test_no_data_links(spark):
    obs = spark.createDataFrame([("s_653-655",)], "link_id string")
    out = control.no_data_links(obs, network(spark, ("653", "655"), ("655", "657"))).collect()
    assert [(r.link_id, r.valid_code, r.is_valid) for r in out] == [("s_655-657", 95, False)]


def test_failure_periods(spark):
    rows = [(i, "s_1-2", at(13, 45), "a", 1, False, 2, h) for i, h in enumerate((6.5, 12.3, 8.7))]
    rows += [(10 + i, "s_3-4", at(h), "a", 1, False, 2, 9.0) for i, h in enumerate((5, 6, 11, 15, 20, 23))]
    rows += [(30, "s_9-9", at(1), "a", 1, False, 2, 9.0)]
    df = spark.createDataFrame(
        rows, "data_id long, link_id string, timestamp timestamp_ntz, polyline string, route_alternative int, is_valid boolean, valid_code int, hausdorff_distance double"
    )
    out = {r.link_id: r for r in control.failure_periods(df, network(spark, ("1", "2"), ("3", "4")), "data_id").collect()}
    assert set(out) == {"s_1-2", "s_3-4"}
    a = out["s_1-2"]
    assert (a.best_hausdorff, a.worst_hausdorff, a.total_fail, a.fail_11_15, a.total_days) == (6.5, 12.3, 3, 3.0, 1)
    b = out["s_3-4"]
    assert (b.fail_00_06, b.fail_06_11, b.fail_11_15, b.fail_15_20, b.fail_20_00) == (1.0, 1.0, 1.0, 1.0, 2.0)


def test_extracts_are_consistent(spark):
    rows = [(i, f"s_{i % 5}-1", at(i % 24), f"p{i % 3}", 1 + i % 2, i % 3 == 0, 2) for i in range(300)]
    df = checked(spark, rows)
    best = {r.data_id for r in control.best_valid(df, ["data_id"]).collect()}
    assert best <= {r[0] for r in rows if r[5]}
    failed = control.failed_observations(df).collect()
    good_groups = {(r[1], r[2]) for r in rows if r[5]}
    assert not {(r.link_id, r.timestamp) for r in failed} & good_groups
    histogram = control.code_histogram(df).collect()
    assert sum(r.percentage for r in histogram) == pytest.approx(100.0)
    assert spatial.id_field(["x", "link_id", "id"]) == "link_id"


def test_day_slots_shift_when_the_interval_does_not_divide_a_day(spark):
    for every in (15, 7, 60, 1000, 2000):
        schedule = CompletenessParams(date(2025, 3, 1), date(2025, 3, 9), every)
        want, at = [], datetime(2025, 3, 1)
        while at < datetime(2025, 3, 10):
            want.append((at.date(), at.strftime("%H:%M:%S")))
            at += timedelta(minutes=every)
        days = spark.sql("SELECT explode(sequence(date'2025-03-01', date'2025-03-09')) AS day")
        got = days.select("day", F.explode(control.day_slots(F.col("day"), schedule)).alias("t")).collect()
        assert sorted((r.day, r.t) for r in got) == want


def test_lookup_of_a_key_with_very_many_portions(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 7 WHEN id < 2500 THEN NULL ELSE id END AS k", "id")
    lookup = df.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v"))
    joined = lookup_join(df, lookup, ["k"], "n", hot_rows=2)
    assert joined.columns == ["k", "id", "v"] and joined.count() == 3000
    assert joined.where("k = 7 AND v = 1999").count() == 2000
    assert joined.where("k IS NULL AND v IS NULL").count() == 500
