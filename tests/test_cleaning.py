import pytest

from linkspark import schema
from linkspark.config import AggregationParams
from linkspark.operators import cleaning

RANGES = AggregationParams(
    duration_range_sec=(0, 3600), distance_range_m=(0, 10000), speed_range_kmh=(0, 150)
)


def measurements(spark):
    rows = [
        (1, 100.0, 1000.0, 50.0), (2, -10.0, 2000.0, 200.0), (3, 300.0, -100.0, 30.0), (4, 10000.0, 5000.0, 40.0),
        (5, None, 3000.0, 60.0),
    ]
    return spark.createDataFrame(rows, "data_id long, duration double, distance double, speed double")


def test_range_rules(spark):
    df = measurements(spark)
    valid = {r.data_id: r.is_valid for r in cleaning.resolve_validity(df, RANGES).collect()}
    assert valid == {1: True, 2: False, 3: False, 4: False, 5: False}
    reasons = {r.invalid_reason: r["count"] for r in cleaning.invalid_reason_table(df, RANGES).collect()}
    assert reasons == {"duration_out_of_range": 3, "distance_out_of_range": 1, "speed_out_of_range": 1}


def test_validity_priority():
    assert cleaning.validity_method(["valid", "is_valid", "valid_code"]) == "boolean_valid_column"
    assert cleaning.validity_method(["is_valid", "valid_code"]) == "boolean_is_valid_column"
    assert cleaning.validity_method(["valid_code"]) == "valid_code_column"
    assert cleaning.validity_method(["speed"]) == "numeric_range_rules"


def test_text_flags_and_codes(spark):
    df = spark.createDataFrame([("TRUE",), ("yes",), ("0",), (None,)], "is_valid string")
    assert [r.is_valid for r in cleaning.resolve_validity(df).collect()] == [True, True, False, False]
    codes = spark.createDataFrame([("OK",), ("BAD",), (None,)], "valid_code string")
    ok = cleaning.resolve_validity(codes, AggregationParams(valid_codes_ok=("OK",)))
    assert [r.is_valid for r in ok.collect()] == [True, False, False]
    none = cleaning.resolve_validity(codes, AggregationParams())
    assert not any(r.is_valid for r in none.collect())


def test_dedup_keeps_first_and_survives_a_group_of_copies(spark):
    copies = spark.range(20000).selectExpr(
        "CASE WHEN id < 15000 THEN 7 ELSE id END AS data_id", "concat('s_', id) AS name",
        "timestamp_ntz'2024-01-01 00:00:00' AS timestamp", "id AS position",
    )
    kept = cleaning.dedup_data_id(copies, ["position"])
    # id 7 occurs only within the copies, ids from 15000 on are single
    assert kept.count() == 5001
    assert kept.where("data_id = 7").first().position == 0


def test_dedup_is_independent_of_partitioning(spark):
    rows = [(i % 50, f"s_{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "data_id long, name string, position long")
    results = {
        tuple(sorted(r.position for r in cleaning.dedup_data_id(df.repartition(n), ["position"]).collect()))
        for n in (1, 3, 8)
    }
    assert results == {tuple(range(50))}


def test_headers(spark):
    raw = spark.createDataFrame([(1, "x", 2)], "DataID long, `Duration (seconds)` string, `My ExtraCol` long")
    assert cleaning.normalize_columns(raw).columns == ["data_id", "duration", "my_extra_col"]
    assert schema.snake_case("RouteAlternative") == "route_alternative"
    assert "polyline" in schema.missing_columns(["DataID", "Name"])
    assert "static_duration" not in schema.missing_columns(["DataID"])
    with pytest.raises(ValueError):
        cleaning.require_columns(raw)


def test_typing(spark):
    raw = spark.createDataFrame([("12", "1,5", "NA"), ("x", "2", "3")], "data_id string, duration string, speed string")
    rows = cleaning.type_columns(raw, ",").collect()
    assert (rows[0].data_id, rows[0].duration, rows[0].speed) == (12, 1.5, None)
    assert (rows[1].data_id, rows[1].duration, rows[1].speed) == (None, 2.0, 3.0)


def test_ids_stay_exact(spark):
    rows = [("9007199254740992",), ("9007199254740993",), ("12.0",), ("",), (None,)]
    df = spark.createDataFrame(rows, "data_id string")
    assert not cleaning.has_text_ids(df)
    assert [r.data_id for r in cleaning.type_columns(df).collect()] == [9007199254740992, 9007199254740993, 12, None, None]
    odd = df.union(spark.createDataFrame([("a-1",)], "data_id string"))
    assert cleaning.has_text_ids(odd)
    kept = cleaning.type_columns(odd, text_ids=True)
    assert kept.where("data_id = 'a-1'").count() == 1 and kept.where("data_id IS NULL").count() == 2
