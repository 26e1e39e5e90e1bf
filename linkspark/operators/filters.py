"""Row selection. Every filter is a plain predicate that Catalyst can push to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.config import AggregationParams, QualityThresholds

#: Longer lists become joins; the result is the same.
LITERAL_LIST_LIMIT = 1000


def by_date_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Both ends included; either may be open."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(str(end)).cast("date"))
    return df


def _by_members(df: DataFrame, column: str, wanted, low: int, high: int) -> DataFrame:
    if wanted is None or column not in df.columns:
        return df
    usable = [w for w in wanted if isinstance(w, int) and low <= w <= high]
    return df.where(F.col(column).isin(usable)) if usable else df


def by_weekday(df: DataFrame, weekdays) -> DataFrame:
    """Unusable indices are dropped; when none is left nothing is filtered."""
    return _by_members(df, "weekday_index", weekdays, 0, 6)


def by_hour(df: DataFrame, hours) -> DataFrame:
    return _by_members(df, "hour_of_day", hours, 0, 23)


def _link_list(links) -> list[str]:
    if links is None:
        return []
    names = links.split(",") if isinstance(links, str) else links
    return [n.strip() for n in names if n.strip()]


def by_links(df: DataFrame, whitelist=None, blacklist=None, column: str = "name") -> DataFrame:
    """Keep / drop named links. Long lists become semi / anti joins."""
    for names, how in ((_link_list(whitelist), "left_semi"), (_link_list(blacklist), "left_anti")):
        if not names:
            continue
        if len(names) > LITERAL_LIST_LIMIT:
            listed = df.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], f"`{column}` string")
            df = df.join(listed, column, how).select(*df.columns)
        else:
            hit = F.col(column).isin(names)
            df = df.where(hit if how == "left_semi" else ~F.coalesce(hit, F.lit(False)))
    return df


def by_preset(df: DataFrame, weekday_only=False, weekend_only=False, holiday_only=False) -> DataFrame:
    """Quick selections on the day type, or on the weekday where there is no day type."""
    weekday_sets = {"weekday": [0, 1, 2, 3, 4], "weekend": [5, 6]}
    chosen = [
        name
        for name, on in (("weekday", weekday_only), ("weekend", weekend_only), ("holiday", holiday_only))
        if on
    ]
    for name in chosen:
        if "daytype" in df.columns:
            df = df.where(F.col("daytype") == name)
        elif "weekday_index" in df.columns and name in weekday_sets:
            df = df.where(F.col("weekday_index").isin(weekday_sets[name]))
    return df


def select_observations(df: DataFrame, params: AggregationParams) -> DataFrame:
    """All configured selections, AND-ed."""
    return (
        df.transform(by_date_range, params.start_date, params.end_date)
        .transform(by_weekday, params.weekday_include)
        .transform(by_hour, params.hours_include)
        .transform(by_links, params.whitelist_links, params.blacklist_links)
        .transform(by_preset, params.weekday_only, params.weekend_only, params.holiday_only)
    )


def by_report_dates(df: DataFrame, specific_day=None, start_date=None, end_date=None) -> DataFrame:
    """One day, or whole days from start to end (the end day is included to its last second)."""
    day = F.to_date("timestamp")
    if specific_day is not None:
        return df.where(day == F.lit(str(specific_day)).cast("date"))
    if start_date is not None and end_date is not None:
        return df.where(
            (day >= F.lit(str(start_date)).cast("date")) & (day <= F.lit(str(end_date)).cast("date"))
        )
    return df


def by_map_time(df: DataFrame, dates=None, hours=None) -> DataFrame:
    """Inclusive ranges of ``date`` and ``hour``."""
    if dates is not None:
        df = df.transform(by_date_range, *dates)
    if hours is not None:
        df = df.where(F.col("hour").between(*hours))
    return df


def by_attributes(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """``{column: {"operator": above | below | between, "value": ...}}``; unknown columns are skipped."""
    for column, rule in rules.items():
        if column not in df.columns:
            continue
        operator, value = rule.get("operator"), rule.get("value")
        if operator == "above":
            df = df.where(F.col(column) > value)
        elif operator == "below":
            df = df.where(F.col(column) < value)
        elif operator == "between":
            low, high = value if isinstance(value, (list, tuple)) else (value, value)
            df = df.where(F.col(column).between(low, high))
    return df


def by_text(
    df: DataFrame, field: str, value: str = "", more: str = "", case_sensitive=False, exact=False
) -> DataFrame:
    """Any of the terms (``more`` holds one per line) contained in, or equal to, a field."""
    terms = [t.strip() for t in [value, *more.split("\n")] if t.strip()]
    if field not in df.columns or not terms:
        return df
    text = F.coalesce(F.col(field).cast("string"), F.lit(""))
    if not case_sensitive:
        text, terms = F.lower(text), [t.lower() for t in terms]
    tests: list[Column] = [(text == t) if exact else text.contains(t) for t in terms]
    return df.where(reduce(lambda a, b: a | b, tests))


def drop_sparse(df: DataFrame, min_observations: int | None = None) -> DataFrame:
    """Only rows with enough valid observations."""
    limit = QualityThresholds().min_observations_reliable if min_observations is None else min_observations
    return df.where(F.col("n_valid") >= limit)


def flagged_records(df: DataFrame, limits: QualityThresholds = QualityThresholds()) -> DataFrame:
    """Rows with a quality issue, once per ``issue`` they have."""
    speed, duration = F.col("avg_speed_kmh"), F.col("avg_duration_sec")
    issues = {
        "non_positive_speeds": speed <= 0,
        "extreme_speeds": (speed > limits.extreme_high_speed)
        | ((speed > 0) & (speed < limits.extreme_low_speed)),
        "non_positive_durations": duration <= 0,
        "extreme_durations": (duration > limits.extreme_long_duration)
        | ((duration > 0) & (duration < limits.extreme_short_duration)),
        "sparse_observations": F.col("n_valid") < limits.min_observations_sparse,
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in issues.items()]))
    return df.withColumn("issue", F.explode(found))


def map_slice(df: DataFrame, day, hour: int) -> DataFrame:
    """One date and hour of the hourly rollup."""
    return df.where((F.col("date") == F.lit(str(day)).cast("date")) & (F.col("hour") == hour))


def weekly_slice(df: DataFrame, hour: int, daytype: str = "all") -> DataFrame:
    """One hour of the weekly profile, of one day type or of all."""
    if daytype != "all" and "daytype" in df.columns:
        df = df.where(F.col("daytype") == daytype)
    return df.where(F.col("hour") == hour)
