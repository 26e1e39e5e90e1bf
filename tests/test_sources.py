from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from linkspark.sources import csv, network, rollups, sinks

HEADER = "DataID,Name,SegmentID,RouteAlternative,RequestedTime,Timestamp,DayInWeek,DayType,Duration (seconds),Distance (meters),Speed (km/h),Url,Polyline"
ROW = "{id},s_1-2,9,1,00:15:00,01/07/2025 00:16,יום ג,יום חול,265,2771,37.64,u,p"


def write(path, lines, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write("\n".join(lines) + "\n")


@pytest.mark.parametrize(
    "encoding, found", [("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("cp1255", "windows-1255")]
)
def test_charsets(spark, folder, encoding, found):
    path = f"{folder}/raw.csv"
    write(path, [HEADER] + [ROW.format(id=i) for i in range(3)], encoding)
    assert csv.detect_charset(spark, path) == found
    rows = csv.read_observations(spark, path).orderBy("data_id").collect()
    assert [r.data_id for r in rows] == [0, 1, 2]
    assert (rows[0].day_in_week, rows[0].day_type, rows[0].speed) == ("יום ג", "יום חול", 37.64)


def test_greek_guess_is_overruled_for_hebrew_bytes(spark, folder):
    write(f"{folder}/he.txt", ["שלום עולם"] * 3, "cp1255")
    write(f"{folder}/el.txt", ["καλημέρα ψυχή ύφος"] * 3, "iso-8859-7")
    assert csv.detect_charset(spark, f"{folder}/he.txt", "ISO-8859-7") == "windows-1255"
    assert csv.detect_charset(spark, f"{folder}/el.txt", "ISO-8859-7") == "ISO-8859-7"
    write(f"{folder}/fr.txt", ["déjà vu Ü ß û"], "latin-1")
    assert csv.detect_charset(spark, f"{folder}/fr.txt") == "windows-1252"


def test_dialects(spark, folder):
    cases = {
        "comma": (["a,b,c", "1.5,2.5,3"], {"delimiter": ",", "decimal": "."}),
        "semicolon": (["a;b;c", "1,5;2,5;3"], {"delimiter": ";", "decimal": ","}),
        "tab": (["a\tb\tc", "1.5\t2\t3"], {"delimiter": "\t", "decimal": "."}),
        "pipe": (["a|b|c", "1|2|3"], {"delimiter": "|", "decimal": "."}),
        "none": (["abc"], {"delimiter": ",", "decimal": "."}),
    }
    for name, (lines, want) in cases.items():
        write(f"{folder}/{name}.csv", lines)
        assert csv.detect_dialect(spark, f"{folder}/{name}.csv") == want


def test_scan_order_and_missing_columns(spark, folder):
    path = f"{folder}/raw.csv"
    write(path, [HEADER] + [ROW.format(id=i) for i in (5, 3, 9)])
    assert [r.data_id for r in csv.scan(spark, path).orderBy("_row").collect()] == [5, 3, 9]
    write(f"{folder}/bad.csv", ["DataID,Name", "1,2"])
    with pytest.raises(ValueError, match="polyline"):
        csv.scan(spark, f"{folder}/bad.csv")


def test_date_range_ignores_far_years(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 1),), (datetime(1970, 1, 1),), (None,)], "timestamp timestamp_ntz")
    row = csv.date_range(df, now_year=2026).first()
    assert (row.start_date, row.end_date, row.n_rows) == (date(2025, 1, 1), date(2025, 1, 1), 1)
    assert csv.date_range(df).first().start_date == date(1970, 1, 1)


def test_geojson_features_have_plain_decimals(spark):
    rows = [("a", [(15000000.0, 0.00025), (None, float("inf"))]), (None, [(1.5, -2.0)]), ("c", None)]
    df = spark.createDataFrame(rows, "Id string, line array<struct<x: double, y: double>>")
    assert [r.value for r in sinks.geojson_features(df).collect()] == [
        '{"type":"Feature","properties":{"Id":"a"},"geometry":{"type":"LineString","coordinates":[[15000000.0,0.00025],[null,"Infinity"]]}}',
        '{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[[1.5,-2.0]]}}',
        '{"type":"Feature","properties":{"Id":"c"},"geometry":{"type":"LineString"}}',
    ]


def test_network_formats(spark, folder):
    write(
        f"{folder}/net.csv",
        ["id|FROM|to|geometry", "1|A|B|LINESTRING (0 0, 3 4)", "2|B|C|", "3|C|D|LINESTRING (1 1)"],
    )
    links = network.read_wkt_csv(spark, f"{folder}/net.csv", "|")
    assert [(r.Id, r.link_id, len(r.line)) for r in links.collect()] == [("1", "s_A-B", 2)]
    sinks.write_geojson_lines(links.select("Id", "From", "To", "line"), f"{folder}/geo")
    assert network.read_geojson_lines(spark, f"{folder}/geo").first().link_id == "s_A-B"
    links.select("Id", "From", "To", "line").write.parquet(f"{folder}/pq")
    assert network.read_parquet(spark, f"{folder}/pq").count() == 1
    with pytest.raises(ValueError, match="To"):
        network.resolve_fields(spark.createDataFrame([(1, 2)], "Id int, From int"))


def test_csv_sinks(spark, folder):
    df = spark.createDataFrame([("b", None), ("a", 1234567.891), ("c", 0.1)], "link_id string, x double")
    sinks.write_extract_csv(df.coalesce(1), f"{folder}/out")
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(__import__("glob").glob(f"{folder}/out/*.csv")))
    assert text.startswith("﻿link_id,x")
    assert "a,1.23457e+06\n" in text and "c,0.1\n" in text
    assert "b,\n" in text and "c,0.1" in text
    fixed = df.select(sinks.fixed(F.col("x")).alias("x")).collect()
    assert [r.x for r in fixed] == [None, "1234567.891000", "0.100000"]


def test_rollup_runs(spark, folder):
    runs = spark.createDataFrame([("run_1", 1), ("run_2", 2), ("run_2", 3)], "run_id string, v int")
    assert {r.v for r in rollups.newest_run(runs).collect()} == {2, 3}
    weekly = spark.createDataFrame([("s_1-2", "weekday", 8, 10.5, 30.0, 3)], "link_id string, daytype string, hour_of_day int, avg_dur double, avg_speed double, n_days long")
    sinks.write_csv(weekly, f"{folder}/weekly")
    row = rollups.read_rollup(spark, f"{folder}/weekly", "csv").first()
    assert (row.hour, row.avg_duration_sec, row.avg_speed_kmh, row.n_days) == (8, 10.5, 30.0, 3)


def test_numbers_of_extracts(spark):
    values = [0.000123456789, 12345678.9, 1.0, 0.5, 100000.0, 999999.5, 1e-5, -2.5, 0.0, 123456.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.t for r in df.select(sinks.significant(F.col("x")).alias("t")).collect()]
    assert got == [None if v is None else f"{v:.6g}" for v in values]
