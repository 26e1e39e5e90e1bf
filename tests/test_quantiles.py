import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkspark.operators import classify, quantiles, spatial
from linkspark.operators.quantiles import exact_median, exact_quantiles, quantile_row, rank_ranges

PROBABILITIES = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]


def check(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    got = exact_quantiles(df, "v", PROBABILITIES).first().q
    assert got == pytest.approx(list(np.percentile(values, [100 * p for p in PROBABILITIES])), rel=1e-12, abs=1e-12)


def test_spread_ties_and_tiny_inputs(spark):
    rng = np.random.default_rng(1)
    check(spark, rng.normal(size=5000))
    check(spark, np.concatenate([np.full(4000, 3.5), rng.uniform(0, 10, 1000)]))  # one hot value
    check(spark, [7.0])
    check(spark, [1.0, 2.0])
    check(spark, np.repeat([1.0, 2.0, 3.0], 100))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_any_values(spark, values):
    check(spark, values)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_many_columns_in_one_selection(spark, monkeypatch, rounds):
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    rng = np.random.default_rng(rounds)
    columns = [rng.normal(size=3000), np.where(rng.random(3000) < 0.6, 2.5, rng.random(3000)), rng.integers(0, 4, 3000) * 1.0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns)] + [(None, float("nan"), None)], "a double, b double, c double")
    wanted = {"qa": ("a", PROBABILITIES), "qb": (F.col("b"), [0.5]), "qc": ("c", [0.1, 0.9]), "none": (F.lit(None).cast("double"), [0.5])}
    row = quantile_row(df, wanted, [F.count("*").alias("n"), F.max("a").alias("top")], rounds).first()
    assert row.n == 3001 and row.top == columns[0].max() and row.none == [None]
    for name, values in zip(["qa", "qb", "qc"], columns):
        assert row[name] == pytest.approx(list(np.percentile(values, [100 * p for p in wanted[name][1]])), rel=1e-12, abs=1e-12)


def test_windows_sort_few_values(spark, monkeypatch):
    # the different values that one task sorts: about one in so many ranges to the power of the rounds
    monkeypatch.setattr(quantiles, "BUCKETS", 16)
    df = spark.range(20000).select((F.rand(3) * 1e6).alias("v"))
    plan = quantile_row(df, {"q": ("v", [0.5])}, rounds=2)._jdf.queryExecution().toString()
    assert plan.count("percentile_approx") >= 2
    values = sorted(r.v for r in df.collect())
    assert quantile_row(df, {"q": ("v", [0.5])}, rounds=2).first().q == [pytest.approx((values[9999] + values[10000]) / 2)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "v double")
    assert exact_quantiles(df, "v", [0.5]).first().q == [None]
    assert spark.range(1).select(exact_median(df, "v").alias("m")).first().m is None


def test_global_rank_with_a_hot_value(spark):
    rows = [(f"k{i:04d}", 5.0 if i % 3 else float(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "link_id string, length_m double").repartition(5)
    ranked = spatial.priority_batches(df, 100).collect()
    assert sorted(r.position for r in ranked) == list(range(1, 1501))
    ordered = sorted(ranked, key=lambda r: r.position)
    assert all(a.length_m >= b.length_m for a, b in zip(ordered, ordered[1:]))
    assert all(r.batch == (r.position - 1) // 100 for r in ranked)


@pytest.mark.parametrize("kind", ["few", "one", "spread", "none"])
def test_ranges_of_ranks_are_bounded(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "RANGE_ROWS", 2000)
    value = {
        "few": F.pmod("id", F.lit(5)).cast("double"), "one": F.lit(3.0), "none": F.lit(None).cast("double"),
        # a third of all rows is one value, the others lie close together far from the median
        "spread": F.when(F.col("id") % 3 == 0, 7.0).otherwise(1e9 + F.col("id")),
    }[kind]
    df = spark.range(1_000_000).select(F.col("id").alias("link_id"), value.alias("length_m"))
    sizes = rank_ranges(df, "length_m", "link_id").groupBy("__b1", "__b2", "__t").count()
    assert sizes.agg(F.max("count")).first()[0] <= 4 * 2000
    ranked = spatial.priority_batches(df, 1000)
    got = ranked.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()
    assert tuple(got) == (1, 1_000_000, 1_000_000)
    ordered = ranked.selectExpr("position", "length_m", "md5(CAST(link_id AS STRING)) AS h").where("position % 1000 < 2").orderBy("position").collect()
    key = [(-(r.length_m if r.length_m is not None else float("-inf")), r.h) for r in ordered]
    assert key == sorted(key)


def classes(spark, values, method, **kwargs):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    return [r.class_index for r in classify.classify(df, "v", method, **kwargs).orderBy("i").collect()]


def test_classes_match_digitize(spark):
    values = np.random.default_rng(2).gamma(2.0, 30.0, 300)

    def expected(breaks, last):
        return list(np.clip(np.digitize(values, breaks) - 1, 0, last))

    assert classes(spark, values, "quantiles") == expected(np.percentile(values, np.linspace(0, 100, 6)), 4)
    assert classes(spark, values, "equal_interval") == expected(np.linspace(values.min(), values.max(), 6), 4)
    inner = [values.mean() + i * values.std() for i in range(-2, 3)]
    inner[0], inner[-1] = min(inner[0], values.min()), max(inner[-1], values.max())
    assert classes(spark, values, "standard_deviation") == expected(sorted(inner), 3)
    assert classes(spark, values, "manual", manual_breaks=[100, 0, 50]) == expected([0, 50, 100], 1)
    with pytest.raises(ValueError):
        classes(spark, values, "manual")
    with pytest.raises(ValueError):
        classes(spark, values, "other")


def test_scales_and_ramp(spark):
    df = spark.createDataFrame([(0, 10.0), (3, 20.0), (99, None)], "n_valid int, v double")
    widths = [r.line_width for r in classify.width_scale(df, mapping="linear").orderBy("n_valid").collect()]
    assert widths == pytest.approx([1.0, 1 + 7 * 3 / 99, 8.0])
    opacity = [r.opacity for r in classify.opacity_scale(df).orderBy("n_valid").collect()]
    assert opacity == pytest.approx([0.3, 0.3 + 0.7 * np.log1p(3) / np.log1p(99), 1.0])
    constant = df.withColumn("n_valid", F.lit(4))
    assert {r.line_width for r in classify.width_scale(constant).collect()} == {1.0}
    colors = [r.color for r in classify.color_ramp(df, "v").orderBy("n_valid").collect()]
    assert colors == ["#00ff00", "#ff0000", "#999999"]
    for preset in classify.PRESETS:
        rows = df.selectExpr("n_valid", "v AS avg_duration_sec", "v AS avg_speed_kmh")
        assert classify.symbology(rows, preset=preset).count() == 3
