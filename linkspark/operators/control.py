"""Validation of observed routes against the reference network, and the extracts and reports on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.config import CompletenessParams, ValidationParams
from linkspark.functions import geometry, measure, polyline, text
from linkspark.functions.projection import project_line
from linkspark.functions.temporal import DAY_PERIODS, day_period
from linkspark.operators.cleaning import dedup_observations
from linkspark.operators.filters import by_report_dates
from linkspark.operators.grouping import HOT_ROWS, keep_first, lookup_join, with_group_stats

# --- fixed values: validation codes ---
CODE_NO_ALTERNATIVE, CODE_SINGLE, CODE_MULTI = 1, 2, 3
CODE_MISSING_FIELD, CODE_BAD_NAME, CODE_NO_LINK, CODE_BAD_POLYLINE = 90, 91, 92, 93
CODE_MISSING_OBSERVATION, CODE_NO_DATA_LINK = 94, 95
CODE_TEXT = {
    1: "No route alternative (geometry-only)",
    2: "Single route alternative",
    3: "Multiple route alternatives",
    90: "Required fields missing",
    91: "Name parse failure",
    92: "Link not in shapefile",
    93: "Polyline decode failure",
    94: "Missing observation (expected timestamp not found)",
}
FAILURE_TEXT = {90: "Missing fields", 91: "Name parse error", 92: "Link not in shapefile", 93: "Invalid polyline"}
PERFECT_MATCH_M = 1e-6


def alternatives(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Context code of each row: one or several alternatives at the same link and timestamp."""
    sized = with_group_stats(df, ["name", "timestamp"], {"n_alternatives": F.count("*")}, hot_rows)
    code = F.when(F.col("n_alternatives") == 1, CODE_SINGLE).otherwise(CODE_MULTI)
    return sized.withColumn("context_code", code)


def reference_lookup(df: DataFrame, links: DataFrame) -> DataFrame:
    """Canonical link of each row and whether the network has it (code 92 when not)."""
    known = links.select(F.col("link_id").alias("__ref"), F.lit(True).alias("__known"))
    joined = df.withColumn("link_id", text.canonical_link(F.col("name"))).join(
        known, F.col("link_id") == F.col("__ref"), "left"
    )
    found = F.coalesce("__known", F.lit(False))
    code = (
        F.when(F.col("link_id").isNull(), CODE_BAD_NAME).when(~found, CODE_NO_LINK).otherwise(F.lit(None).cast("int"))
    )
    return joined.withColumns({"in_network": found, "lookup_code": code}).drop("__ref", "__known")


def measure_pairs(pairs: DataFrame, params: ValidationParams) -> DataFrame:
    """Geometry tests of distinct (route, reference) lines ``route``, ``reference`` (both metric)."""
    out = {}
    if params.use_hausdorff:
        out["hausdorff_distance"] = measure.hausdorff(F.col("route"), F.col("reference"))
    if params.use_length_check:
        out["__route_m"] = geometry.line_length(F.col("route"))
        out["__ref_m"] = geometry.line_length(F.col("reference"))
    if params.use_coverage_check:
        share = measure.coverage(F.col("route"), F.col("reference"), params.coverage_spacing_m)
        out["coverage_percent"] = share * 100
    measured = pairs.withColumns(out) if out else pairs
    tests = {}
    if params.use_hausdorff:
        tests["hausdorff_pass"] = F.col("hausdorff_distance") <= params.hausdorff_threshold_m
    if params.use_length_check:
        route, ref = F.col("__route_m"), F.col("__ref_m")
        tested = ref >= params.min_link_length_m
        if params.length_check_mode == "ratio":
            tests["length_ratio"] = F.when(tested, route / F.nullif(ref, F.lit(0.0)))
        elif params.length_check_mode == "exact":
            tests["length_diff"] = F.when(tested, F.abs(route - ref))
        tests["length_pass"] = geometry.length_pass(route, ref, params)
    if params.use_coverage_check:
        tests["coverage_pass"] = F.col("coverage_percent") >= params.coverage_min * 100
    return (measured.withColumns(tests) if tests else measured).drop("__route_m", "__ref_m")


def validate(
    df: DataFrame, links: DataFrame, params: ValidationParams = ValidationParams(), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Verdict per observation: ``is_valid``, ``valid_code`` and the results of the enabled tests.

    ``links`` has ``link_id`` and ``line`` (vertices, metric). Each distinct (link, polyline) pair is
    decoded and measured once; pairs are repartitioned over their own key first, so a link with very
    many routes is measured by many tasks.
    """
    with_alternatives = "route_alternative" in df.columns
    obs = df.drop("is_valid", "valid_code").withColumn("__link", text.canonical_link(F.col("name")))
    pair = ["__link", "polyline"]
    pairs = (
        obs.where(F.col("__link").isNotNull() & F.col("polyline").isNotNull())
        .groupBy(*pair)
        .agg(F.count("*").alias("__rows"))
    )
    reference = links.select(F.col("link_id").alias("__link"), F.col("line").alias("reference"))
    located = pairs.join(reference, "__link", "left").repartition(*pair)
    decoded = located.withColumn(
        # only routes of known links are decoded
        "route",
        project_line(
            polyline.decode(F.when(F.col("reference").isNotNull(), F.col("polyline")), params.polyline_precision),
            params.crs_metric,
        ),
    )
    usable = F.col("route").isNotNull()
    measured = measure_pairs(decoded, params)
    results = [c for c in measured.columns if c not in (*pair, "__rows", "reference", "route")]
    facts = measured.select(
        *pair,
        "__rows",
        F.when(F.col("reference").isNull(), CODE_NO_LINK).when(~usable, CODE_BAD_POLYLINE).alias("__pair_code"),
        *[F.when(usable, F.col(c)).alias(c) for c in results],
    )
    # group sizes come before the join, whose work their pre-pass would repeat
    if with_alternatives:
        sized = with_group_stats(obs, ["name", "timestamp"], {"__n": F.count("*")}, hot_rows)
        context = F.when(F.col("__n") == 1, CODE_SINGLE).otherwise(CODE_MULTI)
    else:
        sized, context = obs, F.lit(CODE_NO_ALTERNATIVE)
    joined = lookup_join(sized, facts, pair, "__rows", hot_rows)

    required = ["name", "polyline"] + (["route_alternative", "timestamp"] if with_alternatives else [])
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    code = (
        F.when(absent, CODE_MISSING_FIELD)
        .when(F.col("__link").isNull(), CODE_BAD_NAME)
        .otherwise(F.coalesce("__pair_code", context))
    )
    tests = [c for c in results if c.endswith("_pass")]
    passed = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in tests], F.lit(True))
    coded = joined.withColumn("valid_code", code)
    clean = F.col("valid_code") < CODE_MISSING_FIELD
    no_time = F.col("timestamp").isNull() if with_alternatives else F.lit(False)
    cleared = {
        c: F.when(clean, F.col(c)).when(no_time, F.lit(False)) if c.endswith("_pass") else F.when(clean, F.col(c))
        for c in results
    }
    return coded.withColumns({"is_valid": clean & passed, **cleared}).drop("__link", "__n", "__pair_code")


def _link(df: DataFrame) -> str:
    return "link_id" if "link_id" in df.columns else "name"


def selection_score(df: DataFrame) -> Column:
    """Closeness first, then length agreement, then coverage; absent measures add nothing."""
    score = F.lit(0.0)
    if "hausdorff_distance" in df.columns:
        score = score - F.coalesce(F.col("hausdorff_distance") * 1000, F.lit(0.0))
    if "length_ratio" in df.columns:
        score = score - F.coalesce(F.abs(F.col("length_ratio") - 1.0) * 100, F.lit(0.0))
    if "coverage_percent" in df.columns:
        score = score + F.coalesce(F.col("coverage_percent"), F.lit(0.0))
    return score


def best_valid(df: DataFrame, order: list[str]) -> DataFrame:
    """Best valid alternative of every link and timestamp; ties go to the first row by ``order``."""
    keys = [_link(df), "timestamp"]
    rows = df.where(F.col("is_valid") & F.col(keys[0]).isNotNull() & F.col("timestamp").isNotNull())
    return keep_first(rows.withColumn("__score", selection_score(df)), keys, [F.desc("__score"), *order]).drop(
        "__score"
    )


def failed_observations(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All rows of the (link, timestamp) groups without a valid alternative."""
    keys = [_link(df), "timestamp"]
    rows = df.where(F.col(keys[0]).isNotNull() & F.col("timestamp").isNotNull())
    judged = with_group_stats(rows, keys, {"__any_valid": F.bool_or(F.coalesce("is_valid", F.lit(False)))}, hot_rows)
    return judged.where(~F.col("__any_valid")).drop("__any_valid")


def failed_geometry(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Failed observations that reached the geometry tests (codes 1 to 3)."""
    return failed_observations(df, hot_rows).where(F.col("valid_code").between(CODE_NO_ALTERNATIVE, CODE_MULTI))


def unique_routes(failed: DataFrame, order: list[str]) -> DataFrame:
    """First row of every distinct route of a link."""
    return keep_first(failed, [_link(failed), "polyline"], order)


def expected_slots(links: DataFrame, schedule: CompletenessParams) -> DataFrame:
    """Every scheduled slot of every link, generated in place (no join)."""
    start = f"timestamp_ntz'{schedule.start_date} 00:00:00'"
    last = f"(timestamp_ntz'{schedule.end_date} 00:00:00' + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND)"
    slots = F.explode(F.expr(f"sequence({start}, {last}, INTERVAL {schedule.interval_minutes} MINUTES)"))
    return links.select("link_id", slots.alias("slot"))


def day_slots(day: Column, schedule: CompletenessParams) -> Column:
    """Times of the scheduled slots of a day; slots are counted on from the first day, so they may shift from day to day."""
    every = schedule.interval_minutes
    first = F.pmod(-F.datediff(day, F.lit(schedule.start_date)) * 1440, F.lit(every))
    minutes = F.sequence(first, F.greatest(first, F.lit(1439)), F.lit(every))
    times = F.transform(minutes, lambda m: F.format_string("%02d:%02d:00", F.floor(m / 60), m % 60))
    return F.when(first <= 1439, times).otherwise(F.array().cast("array<string>"))


def missing_observations(df: DataFrame, schedule: CompletenessParams) -> DataFrame:
    """Scheduled slots without an observation, for links that have some data.

    A slot is present when a row of the link has its requested time and its date.
    """
    link = _link(df)
    day = F.to_date("timestamp")
    scheduled = day.between(F.lit(schedule.start_date), F.lit(schedule.end_date))
    # one row for a link and day, with the times seen; only what is absent becomes rows
    seen = df.where(scheduled).groupBy(F.col(link).alias("link_id"), day.alias("date")).agg(F.collect_set("requested_time").alias("_seen"))
    links = df.select(F.col(link).alias("link_id")).where("link_id IS NOT NULL").distinct()
    days = F.explode(F.sequence(F.lit(schedule.start_date), F.lit(schedule.end_date), F.expr("INTERVAL 1 DAY")))
    both = links.select("link_id", days.alias("date")).join(seen, ["link_id", "date"], "left")
    absent = F.array_except(day_slots(F.col("date"), schedule), F.coalesce("_seen", F.array().cast("array<string>")))
    return both.select(
        "link_id",
        "date",
        F.explode(absent).alias("requested_time"),
        F.lit(False).alias("is_valid"),
        F.lit(CODE_MISSING_OBSERVATION).alias("valid_code"),
    )


def no_data_links(df: DataFrame, links: DataFrame) -> DataFrame:
    """Network links without any observation."""
    seen = df.select(F.col(_link(df)).alias("link_id")).where("link_id IS NOT NULL").distinct()
    return links.join(seen, "link_id", "left_anti").select(
        "link_id", F.lit(False).alias("is_valid"), F.lit(CODE_NO_DATA_LINK).alias("valid_code")
    )


def link_statistics(df: DataFrame) -> DataFrame:
    """Timestamps, successes and alternatives per link.

    Alternatives of one timestamp answer the same request, so a timestamp succeeds when any of them is
    valid. Two aggregations, both with map-side partials.
    """
    link = _link(df)
    alt = F.col("route_alternative") if "route_alternative" in df.columns else F.lit(None).cast("int")
    near = F.col("hausdorff_distance") if "hausdorff_distance" in df.columns else F.lit(None).cast("double")
    valid = F.coalesce("is_valid", F.lit(False))
    per_time = (
        df.where(F.col(link).isNotNull())
        .groupBy(F.col(link).alias("link_id"), "timestamp")
        .agg(
            F.count("*").alias("rows"),
            F.bool_or(valid).alias("ok"),
            F.min(F.when(valid, near)).alias("near"),
            F.min(alt).alias("alt_lo"),
            F.max(alt).alias("alt_hi"),
        )
    )
    timed = F.col("timestamp").isNotNull()
    measured = F.lit("hausdorff_distance" in df.columns)
    perfect = F.coalesce(F.col("near") < PERFECT_MATCH_M, F.lit(False))
    counts = per_time.groupBy("link_id").agg(
        F.count_if(timed).alias("total_timestamps"),
        F.count_if(timed & F.col("ok")).alias("successful_timestamps"),
        F.count_if(timed & F.col("ok") & measured & perfect).alias("perfect_match_observations"),
        F.count_if(timed & F.col("ok") & measured & ~perfect).alias("threshold_pass_observations"),
        F.count_if(timed & (F.col("rows") == 1)).alias("single_route_observations"),
        F.count_if(timed & (F.col("rows") > 1)).alias("multi_route_observations"),
        F.sum("rows").alias("total_routes"),
        F.min("alt_lo").alias("alt_lo"),
        F.max("alt_hi").alias("alt_hi"),
    )
    several = (
        (F.col("multi_route_observations") > 0)
        | F.coalesce(F.col("alt_lo") != F.col("alt_hi"), F.lit(False))
        | F.coalesce(F.col("alt_hi") > 1, F.lit(False))
    )
    return counts.withColumn("has_alternatives", several).drop("alt_lo", "alt_hi")


def with_result_code(stats: DataFrame) -> DataFrame:
    """``result_code``, ``result_label`` and ``num`` (percentage) of link statistics."""
    total, good = F.col("total_timestamps"), F.col("successful_timestamps")
    share = F.when(total > 0, good * 100.0 / total)
    none, full, multi = total == 0, good == total, F.col("has_alternatives")
    code = (
        F.when(none, 41)
        .when(multi & full, 30)
        .when(multi & (good > 0), 31)
        .when(multi, 32)
        .when(full, 0)
        .when(good > 0, 21)
        .otherwise(22)
    )
    label = (
        F.when(none, "did not record")
        .when(multi, "RouteAlternative greater than one")
        .when(full, "valid")
        .when(good > 0, "no RouteAlternative")
        .otherwise("no RouteAlternative and all invalid")
    )
    return stats.withColumns({"result_code": code, "result_label": label, "num": share})


def link_report(
    df: DataFrame,
    links: DataFrame,
    order: list[str],
    schedule: CompletenessParams | None = None,
    specific_day=None,
    start_date=None,
    end_date=None,
) -> DataFrame:
    """One row per network link with its validation percentages and counts."""
    rows = by_report_dates(df, specific_day, start_date, end_date)
    rows = dedup_observations(rows, order, _link(rows))
    joined = links.join(link_statistics(rows), "link_id", "left")
    counters = [
        "total_timestamps", "successful_timestamps", "perfect_match_observations", "threshold_pass_observations",
        "single_route_observations", "multi_route_observations", "total_routes",
    ]
    joined = joined.na.fill(0, counters).na.fill(False, ["has_alternatives"])
    coded = with_result_code(joined)
    total = F.col("total_timestamps")
    failed = total - F.col("successful_timestamps")
    percent = lambda part: F.when(total > 0, part * 100.0 / total)
    out = {
        "failed_timestamps": failed,
        "success_rate": percent(F.col("successful_timestamps")),
        "perfect_match_percent": percent(F.col("perfect_match_observations")),
        "threshold_pass_percent": percent(F.col("threshold_pass_observations")),
        "failed_percent": percent(failed),
        "total_success_rate": percent(F.col("perfect_match_observations"))
        + percent(F.col("threshold_pass_observations")),
        "total_observations": total,
        "successful_observations": F.col("successful_timestamps"),
        "failed_observations": failed,
        "single_alt_timestamps": F.col("single_route_observations"),
        "multi_alt_timestamps": F.col("multi_route_observations"),
    }
    if schedule:
        expected = schedule.expected_observations()
        out["expected_observations"] = F.lit(expected).cast("bigint")
        out["missing_observations"] = F.greatest(F.lit(0).cast("bigint"), F.lit(expected) - total)
        out["data_coverage_percent"] = total * 100.0 / expected if expected else F.lit(0.0)
    return coded.withColumns(out).drop(
        "has_alternatives", "perfect_match_observations", "threshold_pass_observations"
    )


def failure_periods(failed: DataFrame, links: DataFrame, order: str) -> DataFrame:
    """Failures per link and time of day, as a rate per day on which the link failed.

    Days are summarised first, so counting the days needs no distinct pass.
    """
    link = _link(failed)
    triples = {"hausdorff_distance": "hausdorff", "length_ratio": "length_ratio", "coverage_percent": "coverage"}
    present = {c: n for c, n in triples.items() if c in failed.columns}
    period = day_period(F.hour("timestamp"))
    partial = [F.count_if(period == p).alias(f"p_{p}") for p, _, _ in DAY_PERIODS]
    partial += [F.min_by(F.struct("valid_code"), order).alias("code"), F.min(order).alias("at")]
    for column in present:
        partial += [
            F.sum(column).alias(f"sum_{column}"),
            F.count(column).alias(f"cnt_{column}"),
            F.min(column).alias(f"min_{column}"),
            F.max(column).alias(f"max_{column}"),
        ]
    days = failed.groupBy(F.col(link).alias("link_id"), F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("rows"), *partial
    )
    total_days = F.count("*")
    outputs = [
        F.min_by("code", "at")["valid_code"].alias("valid_code"),
        total_days.alias("total_days"),
        F.sum("rows").alias("total_fail"),
    ]
    outputs += [F.round(F.sum(f"p_{p}") / total_days, 2).alias(f"fail_{p}") for p, _, _ in DAY_PERIODS]
    for column, name in present.items():
        low, high = F.min(f"min_{column}"), F.max(f"max_{column}")
        best, worst = (high, low) if name == "coverage" else (low, high)
        mean = F.sum(f"sum_{column}") / F.nullif(F.sum(f"cnt_{column}"), F.lit(0))
        outputs += [mean.alias(f"avg_{name}"), best.alias(f"best_{name}"), worst.alias(f"worst_{name}")]
    return days.groupBy("link_id").agg(*outputs).join(links.select("link_id"), "link_id", "left_semi")


def code_histogram(df: DataFrame) -> DataFrame:
    """Rows and share per validation code, with its description."""
    counted = df.groupBy("valid_code").agg(F.count("*").alias("count"))
    total = counted.agg(F.sum("count").alias("n")).scalar()
    table = [F.lit(part) for item in CODE_TEXT.items() for part in item]
    described = F.coalesce(
        F.try_element_at(F.create_map(*table), F.col("valid_code")),
        F.concat(F.lit("Code "), F.col("valid_code").cast("string")),
    )
    return counted.where("valid_code IS NOT NULL").select(
        "valid_code",
        "count",
        (F.col("count") * 100.0 / total).alias("percentage"),
        described.alias("description"),
    )


def observation_summary(df: DataFrame) -> DataFrame:
    """One row: routes, distinct observations and the share of each that is valid."""
    link = _link(df)
    flag = "hausdorff_pass" if "hausdorff_pass" in df.columns else "is_valid"
    valid = F.coalesce(F.col(flag), F.lit(False))
    groups = df.groupBy(link, "timestamp").agg(
        F.count("*").alias("rows"), F.count_if(valid).alias("valid"), F.bool_or(valid).alias("ok")
    )
    known = F.col(link).isNotNull() & F.col("timestamp").isNotNull()
    return groups.agg(
        F.sum("rows").alias("total_routes"),
        F.sum("valid").alias("valid_routes"),
        F.count_if(known).alias("total_observations"),
        F.count_if(known & F.col("ok")).alias("valid_observations"),
    ).withColumns(
        {
            "valid_routes_percent": F.col("valid_routes") * 100.0 / F.col("total_routes"),
            "valid_observations_percent": F.col("valid_observations") * 100.0 / F.col("total_observations"),
        }
    )


def failure_groups(df: DataFrame) -> DataFrame:
    """Failed (link, timestamp) groups with the number of routes and the tests that no route passed."""
    link = _link(df)
    kinds = [
        ("hausdorff_pass", "hausdorff_distance", "Hausdorff: %.2fm"),
        ("length_pass", "length_ratio", "Length ratio: %.3f"),
        ("coverage_pass", "coverage_percent", "Coverage: %.1f%%"),
    ]
    present = [k for k in kinds if k[0] in df.columns and k[1] in df.columns]
    measures = []
    for flag, value, _ in present:
        measures += [
            F.bool_or(F.coalesce(F.col(flag), F.lit(False))).alias(flag),
            F.avg(value).alias(value),
        ]
    groups = (
        df.where(F.col(link).isNotNull() & F.col("timestamp").isNotNull())
        .groupBy(F.col(link).alias("link_id"), "timestamp")
        .agg(F.count("*").alias("routes_tested"), F.bool_or("is_valid").alias("ok"), *measures)
        .where(~F.coalesce("ok", F.lit(False)))
    )
    reasons = [
        F.when(~F.col(flag), F.format_string(layout, F.col(value))) for flag, value, layout in present
    ]
    joined = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    return groups.select(
        "link_id",
        "timestamp",
        "routes_tested",
        F.when(joined == "", "Unknown").otherwise(joined).alias("failure_reasons"),
    )


def failure_reason(df: DataFrame) -> Column:
    """Readable reason of one failed row."""
    kinds = [
        ("hausdorff_pass", "hausdorff_distance", "Hausdorff: %.1fm", "Hausdorff failed"),
        ("length_pass", "length_ratio", "Length: %.2fx", "Length failed"),
        ("coverage_pass", "coverage_percent", "Coverage: %.1f%%", "Coverage failed"),
    ]
    reasons = []
    for flag, value, layout, bare in kinds:
        if flag not in df.columns:
            continue
        text_ = F.lit(bare)
        if value in df.columns:
            text_ = F.when(F.col(value).isNotNull(), F.format_string(layout, F.col(value))).otherwise(bare)
        reasons.append(F.when(~F.col(flag), text_))
    joined = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    by_code = reduce(
        lambda chain, item: chain.when(F.col("valid_code") == item[0], item[1]),
        list(FAILURE_TEXT.items())[1:],
        F.when(F.col("valid_code") == 90, FAILURE_TEXT[90]),
    ).otherwise("Unknown failure")
    return F.when(joined != "", joined).otherwise(by_code)
