"""Derived time columns, day types and holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.config import AggregationParams
from linkspark.functions import labels, temporal
from linkspark.operators.grouping import keep_first


def choose_timestamp_format(df: DataFrame, column: str, preferred: str) -> str | None:
    """Layout that parses most of a text column, decided once over all rows.

    The last layout above half of the rows wins, the search stops above nine tenths. None means no
    layout is good enough and every row should try all of them.
    """
    formats = list(dict.fromkeys([preferred, *temporal.TIMESTAMP_FORMATS]))
    text = F.col(column)
    checks = [
        F.count_if(text.isNull() | temporal.parse_timestamp(text, fmt).isNotNull()).alias(str(i))
        for i, fmt in enumerate(formats)
    ]
    row = df.agg(F.count("*").alias("n"), *checks).first()
    chosen = None
    for i, fmt in enumerate(formats):
        share = row[str(i)] / row["n"] if row["n"] else 0.0
        if share > 0.5:
            chosen = fmt
            if share > 0.9:
                break
    return chosen


def layout_shares(df: DataFrame, column: str, preferred: str, by: str | None = None) -> DataFrame:
    """``rows`` and the rows that each layout parses (``c0``, ``c1``, ...), for every value of ``by``, in one grouped pass."""
    text = F.col(column)
    counts = [
        F.count_if(text.isNull() | temporal.parse_timestamp(text, fmt).isNotNull()).alias(f"c{i}")
        for i, fmt in enumerate(_layouts(preferred))
    ]
    return df.groupBy(*([by] if by else [])).agg(F.count("*").alias("rows"), *counts)


def _layouts(preferred: str) -> list[str]:
    return list(dict.fromkeys([preferred, *temporal.TIMESTAMP_FORMATS]))


def _leading(preferred: str) -> Column:
    """Number of the layout that a row of :func:`layout_shares` puts first: the first above nine tenths, else the last above half."""
    share = [F.col(f"c{i}") / F.col("rows") for i in range(len(_layouts(preferred)))]
    clear = [F.when(s > 0.9, i) for i, s in enumerate(share)]
    most = [F.when(s > 0.5, i) for i, s in enumerate(share)][::-1]
    return F.coalesce(*clear, *most)


def resolve_timestamps(
    df: DataFrame, preferred: str, column: str = "timestamp", timezone: str | None = None, by: str | None = None
) -> DataFrame:
    """Text to wall-clock timestamp, row by row over a ranked list of layouts; ``_unresolved`` keeps text that none fits.

    The layout that leads in the rows of the same ``by`` (a file, say; without it in all rows) is tried first, so it settles
    text that several fit; then come all others and ISO text with ``T``, fractions or an offset, which is converted to
    ``timezone``. Shares are counted in one grouped pass inside the plan.
    """
    shares = layout_shares(df, column, preferred, by)
    if by:
        leading = shares.select(F.col(by).alias("__by"), _leading(preferred).alias("__lead"))
        known = df.join(leading, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    else:
        known = df.withColumn("__lead", shares.select(_leading(preferred).alias("lead")).scalar())
    text = F.col(column)
    first = None
    for i, fmt in enumerate(_layouts(preferred)):
        test, parsed = F.col("__lead") == i, temporal.parse_timestamp(text, fmt)
        first = F.when(test, parsed) if first is None else first.when(test, parsed)
    parsed = F.coalesce(first, temporal.parse_timestamp_any(text, _layouts(preferred)), temporal.parse_timestamp_free(text, timezone))
    resolved = known.withColumn("__ts", parsed).withColumn("_unresolved", F.when(F.col("__ts").isNull(), F.nullif(F.trim(text), F.lit(""))))
    return resolved.withColumn(column, F.col("__ts")).drop("__ts", "__lead")


def parse_timestamps(df: DataFrame, fmt: str | None, column: str = "timestamp", timezone: str | None = None) -> DataFrame:
    """Text to wall-clock timestamp with one layout, or row by row over all layouts and ISO text.

    Text with an offset is converted to ``timezone``.
    """
    if dict(df.dtypes)[column] != "string":
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    text = F.col(column)
    if fmt:
        parsed = temporal.parse_timestamp(text, fmt)
    else:
        parsed = F.coalesce(temporal.parse_timestamp_any(text), temporal.parse_timestamp_free(text, timezone))
    return df.withColumn(column, parsed)


def add_time_columns(df: DataFrame) -> DataFrame:
    """``date``, ``hour_of_day``, ``iso_week``, ``weekday_index`` (Monday = 0)."""
    ts = F.col("timestamp")
    return df.withColumns(
        {
            "date": F.to_date(ts),
            "hour_of_day": F.hour(ts),
            "iso_week": temporal.iso_week(ts),
            "weekday_index": F.weekday(ts),
        }
    )


def map_day_names(df: DataFrame) -> DataFrame:
    """Weekday from the day-name label where it is known, else the one already derived."""
    if "day_in_week" not in df.columns:
        return df
    mapped = labels.weekday_of_label(F.col("day_in_week"))
    existing = F.col("weekday_index") if "weekday_index" in df.columns else F.lit(None).cast("int")
    return df.withColumn("weekday_index", F.coalesce(mapped, existing))


def map_daytypes(df: DataFrame, custom: dict | None = None) -> DataFrame:
    """``daytype`` from the day-type label, inferred from the weekday where there is no usable label."""
    weekday = F.col("weekday_index") if "weekday_index" in df.columns else F.lit(None).cast("int")
    if "day_type" in df.columns:
        daytype = labels.daytype_of_label(F.col("day_type"), weekday, custom)
    else:
        daytype = labels.daytype_of_weekday(weekday)
    return df.withColumn("daytype", daytype)


def holiday_calendar(*calendars: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """One row per date from several ``date, name`` tables; later tables win.

    ``years`` keeps the span that the data covers.
    """
    ranked = None
    for priority, calendar in enumerate(calendars):
        part = calendar.select("date", "name", F.lit(priority).alias("priority"))
        ranked = part if ranked is None else ranked.unionByName(part)
    if years:
        ranked = ranked.where(F.year("date").between(*years))
    return keep_first(ranked, ["date"], [F.desc("priority"), F.col("name")]).select("date", "name")


def classify_holidays(df: DataFrame, calendar: DataFrame, holidays_as: str = "holiday") -> DataFrame:
    """``is_holiday``, ``holiday_name`` and the day type that holidays count as.

    The calendar has one row per date, so its size is bounded by the days of the covered years.
    """
    dim = calendar.select(F.col("date").alias("__day"), F.col("name").alias("__name"))
    joined = df.join(F.broadcast(dim), df["date"] == F.col("__day"), "left")
    hit = F.col("__day").isNotNull()
    daytype = F.when(hit, F.lit(holidays_as)).otherwise(F.col("daytype"))
    return joined.withColumns(
        {"is_holiday": hit, "holiday_name": F.coalesce("__name", F.lit("")), "daytype": daytype}
    ).drop("__day", "__name")


def enhance(df: DataFrame, params: AggregationParams, calendar: DataFrame | None = None) -> DataFrame:
    """All temporal attributes of cleaned observations with a parsed ``timestamp``."""
    out = df.transform(add_time_columns).transform(map_day_names)
    out = out.transform(map_daytypes, params.daytype_mapping)
    return out if calendar is None else out.transform(classify_holidays, calendar, params.holidays_as)


def top_holidays(df: DataFrame, n: int = 10) -> DataFrame:
    """Holidays with most rows."""
    counted = df.where("is_holiday").groupBy("holiday_name").agg(F.count("*").alias("n_rows"))
    return counted.orderBy(F.desc("n_rows"), "holiday_name").limit(n)
