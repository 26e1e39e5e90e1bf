from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from linkspark.config import AggregationParams, CompletenessParams, is_valid_timezone
from linkspark.functions import labels, temporal as fn
from linkspark.operators import temporal
from linkspark.sources import holidays


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_dst_gap_and_overlap(spark):
    def utc(text):
        return one(spark, fn.local_to_utc(F.lit(text).cast("timestamp_ntz"), "Asia/Jerusalem"))

    assert utc("2025-07-01 12:00:00") == datetime(2025, 7, 1, 9)
    assert utc("2025-01-01 12:00:00") == datetime(2025, 1, 1, 10)
    assert utc("2025-03-28 02:30:00") == datetime(2025, 3, 28, 0, 30)  # gap: one hour forward
    assert utc("2025-10-26 01:30:00") == datetime(2025, 10, 25, 23, 30)  # overlap: standard time
    assert utc("2025-10-26 00:30:00") == datetime(2025, 10, 25, 21, 30)


def test_day_labels(spark):
    rows = [("יום א", 0), ("ב'", 4), (" יום ג' ", 0), ("יום ח", 3), ("???", 2), (None, 1)]
    df = spark.createDataFrame(rows, "day_in_week string, weekday_index int")
    assert [r.weekday_index for r in temporal.map_day_names(df).collect()] == [6, 0, 1, 3, 2, 1]


def test_day_types(spark):
    rows = [("יום חול", 5), ("חג", 1), ("יום לא ידוע", 6), ("unknown", 2), (None, 2), ("x", None)]
    df = spark.createDataFrame(rows, "day_type string, weekday_index int")
    found = [r.daytype for r in temporal.map_daytypes(df).collect()]
    assert found == ["weekday", "holiday", "weekend", "weekday", None, None]
    custom = temporal.map_daytypes(df, {"special": ["unknown"], "weekend": "יום חול"}).collect()
    assert (custom[0].daytype, custom[3].daytype) == ("weekend", "special")
    assert [r.daytype for r in temporal.map_daytypes(df.drop("day_type")).collect()] == [
        "weekend", "weekday", "weekend", "weekday", "weekday", None,
    ]


def test_label_repair(spark):
    assert one(spark, labels.repair_label(F.lit("־¹־µ־½ֲ ־³"))) == "יום ג"
    assert one(spark, labels.repair_label(F.lit("שבת"))) == "שבת"
    latin = "יום".encode("windows-1255").decode("latin-1") + "־"
    assert one(spark, labels.repair_label(F.lit(latin), decode_bytes=True)) == "יום"


def test_timestamp_format_choice(spark):
    # above nine tenths the search stops at once, below it a later layout may take over
    df = spark.createDataFrame([("01/07/2025 00:16",)] * 19 + [("bad",)], "timestamp string")
    assert temporal.choose_timestamp_format(df, "timestamp", "yyyy-MM-dd HH:mm:ss") == "dd/MM/yyyy HH:mm"
    mixed = spark.createDataFrame([("01/07/2025 00:16",), ("2025-07-01 10:00:00",), ("x",)], "timestamp string")
    assert temporal.choose_timestamp_format(mixed, "timestamp", "yyyy-MM-dd HH:mm:ss") is None
    parsed = [r.timestamp for r in temporal.parse_timestamps(mixed, None).collect()]
    assert parsed == [datetime(2025, 7, 1, 0, 16), datetime(2025, 7, 1, 10), None]


def test_derived_columns(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-12-30 23:59:59' AS timestamp")
    row = temporal.add_time_columns(df).first()
    assert (row.date, row.hour_of_day, row.iso_week, row.weekday_index) == (date(2024, 12, 30), 23, 1, 0)


def test_spreadsheet_times(spark):
    assert one(spark, fn.excel_serial_to_timestamp(F.lit(45474.5))) == datetime(2024, 7, 1, 12)
    assert one(spark, fn.day_fraction_to_time(F.lit(0.666666667))) == "16:00:00"
    assert one(spark, fn.day_fraction_to_time(F.lit(None).cast("double"))) == "00:00:00"


def test_slots_and_periods(spark):
    assert CompletenessParams(date(2025, 7, 1), date(2025, 7, 4), 15).expected_observations() == 384
    assert CompletenessParams(date(2025, 7, 4), date(2025, 7, 1), 15).expected_observations() == 0
    hours = spark.createDataFrame([(h,) for h in (0, 5, 6, 10, 11, 14, 15, 19, 20, 23)], "h int")
    assert [r.p for r in hours.select(fn.day_period(F.col("h")).alias("p")).collect()] == [
        "00_06", "00_06", "06_11", "06_11", "11_15", "11_15", "15_20", "15_20", "20_00", "20_00",
    ]


def test_holiday_sources_and_priority(spark, folder):
    with open(f"{folder}/days.txt", "w") as f:
        f.write("# comment\n2023-01-15 - Spring\n2023-07-04\nnot a date\n2023-13-45 x\n")
    text = holidays.read_custom(spark, f"{folder}/days.txt")
    assert {(r.date, r.name) for r in text.collect()} == {
        (date(2023, 1, 15), "Spring"), (date(2023, 7, 4), "Custom Holiday 2023-07-04"),
    }
    with open(f"{folder}/days.ics", "w") as f:
        f.write(
            "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20230115\r\nSUMMARY:A\r\nEND:VEVENT\r\n"
            "BEGIN:VEVENT\r\nDTSTART:20230704T120000Z\r\nSUMMARY:B\r\nEND:VEVENT\r\n"
            "BEGIN:VEVENT\r\nDTSTART:2023-12-25T00:00:00\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
        )
    ics = holidays.read_custom(spark, f"{folder}/days.ics")
    assert {(r.date, r.name) for r in ics.collect()} == {
        (date(2023, 1, 15), "A"), (date(2023, 7, 4), "B"), (date(2023, 12, 25), "Custom Holiday"),
    }
    merged = {r.date: r.name for r in temporal.holiday_calendar(text, ics).collect()}
    assert merged[date(2023, 1, 15)] == "A" and len(merged) == 3
    only = temporal.holiday_calendar(text, ics, years=(2024, 2025))
    assert only.count() == 0


@pytest.mark.parametrize("treat", ["holiday", "weekend", "weekday"])
def test_holiday_treatment(spark, treat):
    df = spark.createDataFrame([(date(2024, 1, 1), "weekday"), (date(2024, 1, 2), "weekday")], "date date, daytype string")
    calendar = spark.createDataFrame([(date(2024, 1, 1), "New Year")], "date date, name string")
    rows = {r.date.day: r for r in temporal.classify_holidays(df, calendar, treat).collect()}
    assert (rows[1].is_holiday, rows[1].holiday_name, rows[1].daytype) == (True, "New Year", treat)
    assert (rows[2].is_holiday, rows[2].holiday_name, rows[2].daytype) == (False, "", "weekday")


def test_parameter_checks():
    assert is_valid_timezone("Asia/Jerusalem") and not is_valid_timezone("Mars/Base")
    for bad in ({"min_valid_per_hour": 1001}, {"timezone": "nowhere"}, {"weekly_grouping": "month"}, {"holidays_as": "x"}):
        with pytest.raises(ValueError):
            AggregationParams(**bad).check()
    assert AggregationParams().check()
