import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkspark.config import ValidationParams
from linkspark.functions import bearings, geometry, measure, polyline, projection
from linkspark.functions.lines import POINT
from linkspark.operators import spatial
from linkspark.workload.encoding import encode

LINE = "array<struct<x: double, y: double>>"
EXAMPLE = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def batch(lines):
    return pa.array([None if ln is None else [{"x": x, "y": y} for x, y in ln] for ln in lines], pa.list_(POINT))


def test_decoding(spark):
    texts = pa.array([EXAMPLE, "invalid_polyline", "INVALID_POLYLINE", "", None, "??", "a b", EXAMPLE])
    out = polyline.decode_batch(texts, 5).to_pylist()
    want = [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    for got in (out[0], out[7]):
        assert [(round(p["x"], 9), round(p["y"], 9)) for p in got] == want
    assert out[1:7] == [None] * 6
    sliced = polyline.decode_batch(texts.slice(6, 2), 5).to_pylist()
    assert sliced[0] is None and len(sliced[1]) == 3
    assert polyline.decode_batch(pa.array([], pa.string()), 5).to_pylist() == []


def test_decoding_inverts_encoding(spark):
    rng = random.Random(7)
    rows = [(i, [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(rng.randint(2, 40))]) for i in range(60)]
    df = spark.createDataFrame(rows, f"id long, line {LINE}")
    texts = df.withColumn("encoded", encode(F.col("line"))).repartition(3)
    out = texts.withColumn("again", polyline.decode(F.col("encoded"))).collect()
    for r in out:
        assert len(r.again) == len(r.line)
        assert all(abs(a.x - b.x) < 6e-6 and abs(a.y - b.y) < 6e-6 for a, b in zip(r.line, r.again))


def slow_distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def slow_hausdorff(a, b):
    def side(u, v):
        return max(min(slow_distance(p, s, e) for s, e in zip(v, v[1:])) for p in u)

    return max(side(a, b), side(b, a))


def test_hausdorff_against_brute_force(monkeypatch):
    rng = random.Random(3)

    def line():
        return [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randint(2, 12))]

    left, right = [line() for _ in range(80)], [line() for _ in range(80)]
    left[5] = [(1.0, 1.0), (1.0, 1.0)]
    want = [slow_hausdorff(a, b) for a, b in zip(left, right)]
    assert measure.hausdorff_batch(batch(left), batch(right)) == pytest.approx(want)
    monkeypatch.setattr(measure, "SLICE", 17)
    assert measure.hausdorff_batch(batch(left), batch(right)) == pytest.approx(want)
    odd = measure.hausdorff_batch(batch([None, [(0, 0)], []]), batch([[(0, 0), (1, 1)]] * 3))
    assert np.isinf(odd).all()


def test_coverage(spark):
    ref = [(0, 0), (10, 0)]
    routes = [ref, [(0, 0), (5, 0)], [(0, 0.5), (10, 0.5)], [(0, 50), (10, 50)], [(0, 5), (0, -5)]]
    share = measure.coverage_batch(batch(routes), batch([ref] * 5), 1.0)
    assert share[:4] == pytest.approx([1.0, 0.5, 1.0, 0.0])
    assert share[4] == pytest.approx(0.1)  # crossing: only samples within the spacing
    assert measure.coverage_batch(batch([ref]), batch([[(1, 1), (1, 1)]]), 1.0) == pytest.approx([0.0])


def test_length_rules(spark):
    p = ValidationParams(length_check_mode="ratio")

    def passes(route, ref, params=p):
        col = geometry.length_pass(F.lit(float(route)), F.lit(float(ref)), params)
        return spark.range(1).select(col.alias("x")).first().x

    assert passes(100, 100) and passes(110, 100) and not passes(111, 100) and not passes(89, 100)
    assert passes(500, 19.9)  # short links are not tested
    exact = ValidationParams(length_check_mode="exact")
    assert passes(100.5, 100, exact) and not passes(100.6, 100, exact)
    assert passes(1, 100, ValidationParams(length_check_mode="off"))

    def similar(route, ref, mode):
        col = geometry.length_similar(F.lit(float(route)), F.lit(float(ref)), mode, p)
        return spark.range(1).select(col.alias("x")).first().x

    assert similar(11.4, 10, "ratio") and not similar(11.6, 10, "ratio") and not similar(114, 100, "ratio")
    assert similar(0.4, 0, "exact") and not similar(0.6, 0, "ratio") and similar(5, 1, "off")


def test_projection_round_trip_and_known_points():
    rng = np.random.default_rng(5)
    lon, lat = rng.uniform(34.2, 35.7, 500), rng.uniform(29.5, 33.3, 500)
    for crs, tolerance in (("EPSG:2039", 1e-8), ("EPSG:32636", 1e-9), ("EPSG:3857", 1e-10)):
        x, y = projection.project(lon, lat, crs)
        back = projection.unproject(x, y, crs)
        assert np.abs(back[0] - lon).max() < tolerance and np.abs(back[1] - lat).max() < tolerance
    # the central meridian and origin of the grid map close to the false origin (datum shift of some 60 m)
    x, y = projection.project(np.array([35.2045169444444]), np.array([31.7343936111111]), "EPSG:2039")
    assert abs(x[0] - 219529.584) < 100 and abs(y[0] - 626907.39) < 100
    # UTM: a point on the central meridian has easting 500 km
    x, y = projection.project(np.array([33.0]), np.array([0.0]), "EPSG:32636")
    assert x[0] == pytest.approx(500000.0, abs=1e-6) and y[0] == pytest.approx(0.0, abs=1e-6)
    # quarter meridian of WGS84 scaled by 0.9996
    y = projection.project(np.array([33.0]), np.array([89.999999999]), "EPSG:32636")[1]
    assert y[0] == pytest.approx(10001965.729 * 0.9996, abs=0.01)


def test_projected_lengths_match_the_ground(spark):
    line = [(35.0, 32.0), (35.0, 32.001)]  # 0.001 degree of latitude is 110.9 m here
    df = spark.createDataFrame([(line,)], f"line {LINE}")
    length = spatial.with_length(spatial.project(df, "EPSG:2039")).first().length_m
    assert length == pytest.approx(110.9, abs=0.1)


def test_octants(spark):
    angles = [0, 22.4, 22.5, 67.5, 112.5, 157.5, 202.5, 247.5, 292.5, 337.4, 337.5, 359.9, -45.0, 720.0]
    df = spark.createDataFrame([(float(a),) for a in angles], "a double")
    codes = [r.c for r in df.select(bearings.octant_code(F.col("a")).alias("c")).collect()]
    assert codes == [1, 1, 2, 3, 4, 5, 6, 7, 8, 8, 1, 1, 8, 1]


def test_known_geodesic(spark):
    # Flinders Peak to Buninyong, the published test line
    lon1, lat1 = 144 + 25 / 60 + 29.52440 / 3600, -(37 + 57 / 60 + 3.72030 / 3600)
    lon2, lat2 = 143 + 55 / 60 + 35.38390 / 3600, -(37 + 39 / 60 + 10.15610 / 3600)
    a = spark.range(1).select(
        bearings.geodesic_azimuths(F.lit(lon1), F.lit(lat1), F.lit(lon2), F.lit(lat2)).alias("a")
    ).first().a
    assert a.forward == pytest.approx(306 + 52 / 60 + 5.37 / 3600, abs=1e-5)
    assert a.back == pytest.approx(127 + 10 / 60 + 25.07 / 3600, abs=1e-5)


def test_azimuth_table(spark):
    rows = [("1", [(35.0, 32.0), (35.0, 32.01)]), ("2", [(35.0, 32.0), (35.01, 32.0)]), ("3", [(35.0, 32.0), (35.0, 32.0)])]
    table = {r.kid: r for r in spatial.azimuth_table(spark.createDataFrame(rows, f"id string, line {LINE}")).collect()}
    assert (table["1"].Id, table["1"].dir_a, table["1"].dir_b, table["1"].travel_mode) == ("1-51", "N", "S", "5-1")
    assert (table["2"].dir_a, table["2"].dir_b, table["2"].axis_fix) == ("E", "W", 0)
    assert table["1"].start_coord == "32.000000000000000,35.000000000000000"
    assert table["3"].azi_a is None and table["3"].azi_a_pl is None


def test_selection_and_parts(spark):
    rows = [("in", [(1.0, 1.0), (2.0, 2.0)]), ("through", [(-5.0, 5.0), (15.0, 5.0)]), ("out", [(20.0, 0.0), (30.0, 0.0)]), ("touch", [(10.0, 12.0), (10.0, 10.0)])]
    df = spark.createDataFrame(rows, f"link_id string, line {LINE}")
    assert {r.link_id for r in spatial.select_box(df, 0, 0, 10, 10).collect()} == {"in", "through", "touch"}
    triangle = [(0, 0), (10, 0), (0, 10)]
    assert {r.link_id for r in spatial.select_polygon(df, triangle).collect()} == {"in", "through"}
    assert "out" in {r.link_id for r in spatial.select_viewport(df, (0, 0, 19, 10), 0.1).collect()}
    parts = spark.createDataFrame(
        [("a", 0, [(0.0, 0.0), (1.0, 0.0)]), ("a", 1, [(1.0, 0.0), (2.0, 0.0)]), ("b", 0, [(0.0, 0.0), (1.0, 0.0)]), ("b", 1, [(5.0, 0.0), (9.0, 0.0)])],
        f"link_id string, part int, line {LINE}",
    )
    merged = {r.link_id: r for r in spatial.merge_parts(parts).collect()}
    assert merged["a"].merged and [p.x for p in merged["a"].line] == [0.0, 1.0, 2.0]
    assert not merged["b"].merged and [p.x for p in merged["b"].line] == [5.0, 9.0]


def test_wkt(spark):
    df = spark.createDataFrame([("LINESTRING (1 2, 3.5 -4)",), ("POINT (1 2)",), (None,)], "w string")
    out = df.select(geometry.from_wkt(F.col("w")).alias("l")).collect()
    assert [(p.x, p.y) for p in out[0].l] == [(1.0, 2.0), (3.5, -4.0)] and out[1].l is None and out[2].l is None


def test_wkt_of_large_and_small_coordinates_has_plain_decimals(spark):
    df = spark.createDataFrame([([(15000000.0, -12345678.25), (0.00025, 0.0)],), ([(9999999.5, 1e16), (1e-5, -0.5)],)], f"l {LINE}")
    out = [r.w for r in df.select(geometry.to_wkt(F.col("l")).alias("w")).collect()]
    assert out == ["LINESTRING (15000000.0 -12345678.25, 0.00025 0.0)", "LINESTRING (9999999.5 1.0E16, 1.0E-5 -0.5)"]


def test_a_full_batch_of_short_lines_needs_little_memory():
    import tracemalloc

    lines = [[(200.0 * i, 50.0 * (i * k % 3)) for i in range(5)] for k in range(10_000)]
    route, reference = batch([[(x, y + 2) for x, y in line] for line in lines]), batch(lines)
    tracemalloc.start()
    share = measure.coverage_batch(route, reference, 5.0)
    distance = measure.hausdorff_batch(route, reference)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (share == 1).all() and (distance <= 2).all()
    assert most < 64 << 20


def test_coverage_of_long_lines_needs_bounded_memory():
    import tracemalloc

    lines = [[(0.0, i * 10.0), (2500.0, i * 10.0), (5000.0, i * 10.0)] for i in range(1500)] + [[(0.0, 0.0), (1_000_000.0, 0.0)]]
    half = [[(0.0, y), (x / 2, y)] for ((_, y), *_, (x, _)) in lines]
    reference, route = batch(lines), batch(half)
    tracemalloc.start()
    share = measure.coverage_batch(route, reference, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(share, 0.5, atol=1e-3)
    assert peak < 300e6


def test_antipodal_geodesics(spark):
    # published cases, their mirrored forms, and points to whose antipodes every method must find the way
    cases = [
        (0.0, 0.0, 179.5, 0.5, 25.6718728683), (0.0, -30.0, 179.8, 29.9, 161.8905247363),
        (0.0, 0.0, 179.5, -0.5, 180 - 25.6718728683), (0.0, 0.0, -179.5, 0.5, 360 - 25.6718728683),
        (0.0, 0.0, 179.7, 0.5, 15.5568827857),
        (170.0, -30.0, -10.2, 29.9, 161.8905247363),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a double, b double, c double, d double, want double")
    got = rows.select("i", "want", bearings.geodesic_azimuths(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("z")).collect()
    for r in got:
        assert r.z.forward == pytest.approx(r.want, abs=1e-6)
    # the way back from the second point is the first point's answer seen from there
    turned = rows.select("i", bearings.geodesic_azimuths(F.col("c"), F.col("d"), F.col("a"), F.col("b")).alias("z")).collect()
    back = {r.i: r.z for r in turned}
    for r in got:
        assert back[r.i].forward == pytest.approx(r.z.back, abs=1e-6) and back[r.i].back == pytest.approx(r.z.forward, abs=1e-6)


def test_grid_finds_the_nearest_segment(monkeypatch):
    from linkspark.functions import measure

    rng = np.random.default_rng(4)
    counts = np.array([70, 200, 0, 1, 500])
    x = np.concatenate([np.cumsum(rng.normal(size=c + 1)) * s for c, s in zip(counts, (1, 1000, 1, 1, 0.01)) if c])
    y = np.concatenate([np.cumsum(rng.normal(size=c + 1)) * s for c, s in zip(counts, (1, 1, 1, 1, 0.01)) if c])
    segments, per_row = measure._segments(x, y, counts[counts > 0] + 1)
    full = np.insert(per_row, 2, 0)
    row = rng.integers(0, 5, 3000)
    px, py = rng.normal(size=3000) * 300, rng.normal(size=3000) * 300
    plain = measure._nearest_of_all(px, py, row, segments, full)
    assert measure.nearest(px, py, row, segments, full) == pytest.approx(plain, rel=1e-9, abs=1e-9)
    monkeypatch.setattr(measure, "SLICE", 50)
    assert measure.nearest(px, py, row, segments, full) == pytest.approx(plain, rel=1e-9, abs=1e-9)
    # segments that are all one point
    still = tuple(np.zeros(100) for _ in range(4))
    assert measure.nearest(np.array([3.0]), np.array([4.0]), np.array([0]), still, np.array([100])) == pytest.approx([5.0])


def test_a_very_long_line_is_measured_in_seconds():
    import time

    import pyarrow as pa
    from linkspark.functions import measure

    n = 100_000  # 1,000 km with a vertex every 10 m
    t = np.arange(n) * 10.0
    line = lambda dy: pa.array([[{"x": a, "y": b} for a, b in zip(t.tolist(), (np.sin(t / 5000) * 2000 + dy).tolist())]])
    a, b = line(0.0), line(3.0)
    start = time.perf_counter()
    share = measure.coverage_batch(a, b, 1.0)
    far = measure.hausdorff_batch(a, b)
    assert time.perf_counter() - start < 60
    assert share[0] == 0.0 and 2.0 < far[0] <= 3.0


def test_zones_meet_links_once(spark):
    rng = np.random.default_rng(6)
    point = lambda x, y: {"x": float(x), "y": float(y)}
    lines = [(i, [point(x, y), point(x + rng.normal() * 5, y + rng.normal() * 5), point(x + 8, y)]) for i, (x, y) in enumerate(rng.uniform(-50, 50, (80, 2)))]
    lines += [(900, []), (901, None)]
    zones = [(z, [point(x, y), point(x + w, y), point(x + w / 2, y + w)]) for z, (x, y, w) in enumerate(zip(*rng.uniform(-50, 50, (2, 25)), rng.uniform(1, 60, 25)))]
    zones += [(99, []), (3, zones[3][1])]
    shape = "array<struct<x: double, y: double>>"
    a = spark.createDataFrame(lines, f"link_id long, line {shape}")
    b = spark.createDataFrame(zones, f"zone_id long, ring {shape}")
    want = []
    for z, ring in zones:
        if ring:
            found = spatial.select_polygon(a.where("size(line) > 0"), [(p["x"], p["y"]) for p in ring]).select("link_id").collect()
            want += [(z, r.link_id) for r in found]
    for cell in (None, 3.0, 1000.0):
        got = spatial.select_zones(a, b, cell)
        assert sorted((r.zone_id, r.link_id) for r in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and len(want) > 30
