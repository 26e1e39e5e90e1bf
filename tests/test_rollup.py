import statistics
from datetime import date

import pytest

from linkspark.operators import rollup

OBS = "name string, date date, hour_of_day int, daytype string, is_valid boolean, duration double, distance double, speed double"


def observations(spark, n=600):
    rows = [
        (f"s_{i % 3}-9", date(2024, 1, 1 + i % 5), i % 4, "weekday", i % 6 != 0, 100.0 + (i * 37 % 101), 500.0, 40.0 + i % 7)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, OBS)


def test_hour_without_valid_rows_is_kept_with_null_metrics(spark):
    rows = [("s_1-2", date(2024, 1, 1), 8, "weekday", False, 10.0, 5.0, 1.0)] * 10
    row = rollup.hourly_aggregation(spark.createDataFrame(rows, OBS)).first()
    assert (row.n_total, row.n_valid, row.valid_hour, row.no_valid_hour) == (10, 0, False, 1)
    assert (row.avg_duration_sec, row.std_duration_sec, row.avg_distance_m, row.avg_speed_kmh) == (None,) * 4


def test_hourly_numbers_and_null_keys(spark):
    rows = [
        ("s_1-2", date(2024, 1, 1), 8, "weekday", True, 10.0, 100.0, 30.0),
        ("s_1-2", date(2024, 1, 1), 8, "weekday", True, 20.0, 300.0, 50.0),
        ("s_1-2", date(2024, 1, 1), 8, "weekday", False, 999.0, 9.0, 9.0),
        ("s_1-2", date(2024, 1, 1), 8, None, True, 1.0, 1.0, 1.0),
    ]
    out = rollup.hourly_aggregation(spark.createDataFrame(rows, OBS), 3).collect()
    assert len(out) == 1
    row = out[0]
    assert (row.n_total, row.n_valid, row.valid_hour) == (3, 2, False)
    assert row.avg_duration_sec == 15.0 and row.std_duration_sec == pytest.approx(statistics.stdev([10, 20]))
    assert (row.avg_distance_m, row.avg_speed_kmh) == (200.0, 40.0)


def test_weekly_uses_valid_hours_only(spark):
    rows = [
        ("s_1-2", date(2024, 1, d), 8, "weekday", n + 1, n, n >= 1, 0, 10.0 * d, None, 5.0, 6.0)
        for d, n in ((1, 5), (2, 0), (3, 8))
    ]
    hourly = spark.createDataFrame(
        rows,
        "link_id string, date date, hour_of_day int, daytype string, n_total long, n_valid long, valid_hour boolean, "
        "no_valid_hour int, avg_duration_sec double, std_duration_sec double, avg_distance_m double, avg_speed_kmh double",
    )
    row = rollup.weekly_profile(hourly).first()
    assert (row.avg_n_valid, row.n_days, row.total_valid_n, row.total_not_valid) == (6.5, 2, 13, 2)
    assert row.avg_dur == 20.0 and row.std_dur is None
    by_day = rollup.weekly_profile(hourly, "weekday_index")
    assert {r.weekday_index for r in by_day.collect()} == {0, 2}


def test_invariants_and_partition_invariance(spark):
    df = observations(spark)
    tables = []
    for parts in (1, 5):
        hourly = rollup.hourly_aggregation(df.repartition(parts))
        rows = sorted(
            (r.link_id, r.date, r.hour_of_day, r.n_total, r.n_valid, round(r.avg_duration_sec or 0, 9)) for r in hourly.collect()
        )
        tables.append(rows)
    assert tables[0] == tables[1]
    assert sum(r[3] for r in tables[0]) == 600
    assert all(r[4] <= r[3] for r in tables[0])
    violations = rollup.hourly_contract(rollup.hourly_aggregation(df)).collect()
    assert sum(r.violations for r in violations) == 0


def test_pooled_std_equals_raw_std(spark):
    df = observations(spark)
    groups = {}
    for r in df.where("is_valid").collect():
        groups.setdefault((r.name, r.hour_of_day), []).append(r.duration)
    for row in rollup.pooled_std(df).collect():
        values = groups[(row.link_id, row.hour_of_day)]
        assert row.n_raw == len(values)
        assert row.std_dur == pytest.approx(statistics.stdev(values), rel=1e-12)


def map_rows(spark):
    rows = [
        ("s_A-B", date(2024, 1, d), h, 100.0 + d + h, 40.0, 2) for d in range(1, 8) for h in (7, 8, 9)
    ]
    return spark.createDataFrame(
        rows, "link_id string, date date, hour int, avg_duration_sec double, avg_speed_kmh double, n_valid long"
    )


def test_map_weekly(spark):
    for method in ("mean", "median"):
        out = {r.hour: r for r in rollup.map_weekly(map_rows(spark), method).collect()}
        assert len(out) == 3 and out[7].n_valid == 14 and out[7].avg_duration_sec == 111.0
    with pytest.raises(ValueError):
        rollup.map_weekly(map_rows(spark), "mode")


def test_weighted_multi_date_mean(spark):
    rows = [("s_A-B", date(2024, 1, 1), 8, 100.0, 1.0, 10), ("s_A-B", date(2024, 1, 2), 8, 120.0, 1.0, 40)]
    df = spark.createDataFrame(rows, map_rows(spark).schema)
    assert rollup.map_weekly(df, "mean", weighted=True).first().avg_duration_sec == 116.0
    assert rollup.map_weekly(df, "mean").first().avg_duration_sec == 110.0


def test_pattern_detail_and_check(spark):
    df = map_rows(spark)
    pattern = rollup.hour_pattern(df, "avg_duration_sec").first()
    assert (pattern.peak_hour, pattern.off_peak_hour) == (9, 7)
    assert pattern.hourly_values == {7: 111.0, 8: 112.0, 9: 113.0}
    detail = rollup.link_detail(df).first()
    assert (detail.total_observations, detail.unique_dates, detail.unique_hours, detail.data_quality) == (42, 7, 3, "moderate")
    check = rollup.aggregation_check(df, rollup.map_weekly(df)).first()
    assert (check.original_records, check.aggregated_records, check.lost_links, check.data_loss) == (21, 3, 0, False)
    done = rollup.rollup_completeness(df).first()
    assert (done.hours_covered, done.min_hour, done.max_hour, done.total_days) == (3, 7, 9, 7)
