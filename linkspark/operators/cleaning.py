"""Header normalisation, typing, validity and deduplication of raw observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark import schema
from linkspark.config import AggregationParams
from linkspark.functions.text import blank_to_null
from linkspark.operators.grouping import keep_first


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename headers to their normalised names (metadata only)."""
    return df.withColumnsRenamed({c: schema.normalised_name(c) for c in df.columns})


def require_columns(df: DataFrame) -> DataFrame:
    """Raise ValueError when a required column is absent."""
    missing = schema.missing_columns(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def whole_number(text: Column) -> Column:
    """Exact BIGINT of a text like ``12`` or ``12.0``; never by way of a double, which is exact to 2**53 only."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("decimal(38,6)").try_cast("bigint"))


def has_text_ids(df: DataFrame) -> bool:
    """Some ``data_id`` is no whole number; the column then stays text."""
    if dict(df.dtypes).get("data_id") != "string":
        return False
    text = blank_to_null(F.col("data_id"), schema.NULL_TOKENS)
    odd = text.isNotNull() & (whole_number(text).isNull() | (text.try_cast("decimal(38,6)") != whole_number(text)))
    return bool(df.where(odd).select(F.lit(1)).take(1))


def type_columns(df: DataFrame, decimal: str = ".", text_ids: bool = False) -> DataFrame:
    """Text columns to their types; blanks and unparsable values become NULL. ``text_ids`` keeps ``data_id`` text."""

    def typed(name: str) -> Column:
        column = F.col(f"`{name}`")
        if dict(df.dtypes)[name] != "string":
            return column
        text = blank_to_null(column, schema.NULL_TOKENS)
        number = F.regexp_replace(text, ",", ".") if decimal == "," else text
        if name == "data_id" and text_ids:
            return text.alias(name)
        if name in schema.LONG_COLUMNS:
            return whole_number(number).alias(name)
        if name in schema.INT_COLUMNS:
            return number.try_cast("double").try_cast("int").alias(name)
        if name in schema.DOUBLE_COLUMNS:
            return number.try_cast("double").alias(name)
        return text.alias(name)

    return df.select(*[typed(c) for c in df.columns])


def in_range(df: DataFrame, column: str, limits: tuple[float, ...]) -> Column:
    """True inside the closed range, False for NULL; True when the column or range is unusable."""
    if column not in df.columns or len(limits) != 2:
        return F.lit(True)
    low, high = limits
    return F.coalesce(F.col(column).between(F.lit(float(low)), F.lit(float(high))), F.lit(False))


def range_rules(df: DataFrame, params: AggregationParams) -> dict[str, Column]:
    """Violation name -> predicate of the violating rows."""
    ranges = {
        "duration": params.duration_range_sec,
        "distance": params.distance_range_m,
        "speed": params.speed_range_kmh,
    }
    return {f"{c}_out_of_range": ~in_range(df, c, limits) for c, limits in ranges.items()}


def validity_method(columns: list[str]) -> str:
    """Which source of validity a table offers, best first."""
    for column, method in (
        ("valid", "boolean_valid_column"),
        ("is_valid", "boolean_is_valid_column"),
        ("valid_code", "valid_code_column"),
    ):
        if column in columns:
            return method
    return "numeric_range_rules"


def resolve_validity(df: DataFrame, params: AggregationParams = AggregationParams()) -> DataFrame:
    """Set a non-null boolean ``is_valid``."""
    method = validity_method(df.columns)
    if method == "boolean_valid_column":
        valid = _truth(df, "valid")
    elif method == "boolean_is_valid_column":
        valid = _truth(df, "is_valid")
    elif method == "valid_code_column":
        codes = [str(c) for c in params.valid_codes_ok]
        valid = F.coalesce(F.col("valid_code").cast("string").isin(codes), F.lit(False)) if codes else F.lit(False)
    else:
        valid = ~reduce(lambda a, b: a | b, range_rules(df, params).values())
    return df.withColumn("is_valid", valid)


def _truth(df: DataFrame, column: str) -> Column:
    if dict(df.dtypes)[column] == "string":
        return F.coalesce(F.upper(F.trim(column)).isin("TRUE", "1", "YES"), F.lit(False))
    return F.coalesce(F.col(column).cast("boolean"), F.lit(False))


def invalid_reasons(df: DataFrame, params: AggregationParams = AggregationParams()) -> DataFrame:
    """``invalid_reason, count`` of the rule or code that made rows invalid; a row may break several rules."""
    method = validity_method(df.columns)
    if method == "valid_code_column":
        bad = resolve_validity(df, params).where(~F.col("is_valid") & F.col("valid_code").isNotNull())
        return bad.groupBy(F.col("valid_code").cast("string").alias("invalid_reason")).agg(
            F.count("*").alias("count")
        )
    if method != "numeric_range_rules":
        return df.sparkSession.createDataFrame([], "invalid_reason string, count bigint")
    rules = range_rules(df, params)
    counted = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counted.unpivot([], list(rules), "invalid_reason", "count")


def invalid_reason_table(df: DataFrame, params: AggregationParams = AggregationParams()) -> DataFrame:
    """:func:`invalid_reasons`, most frequent first."""
    return invalid_reasons(df, params).orderBy(F.desc("count"), "invalid_reason")


def rule_counts(params: AggregationParams, df: DataFrame) -> list[Column]:
    """Aggregates of the rows that break each range rule, to be had from a pass over ``df`` that is made anyway."""
    return [F.count_if(rule).alias(name) for name, rule in range_rules(df, params).items()]


def dedup_data_id(df: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(df, ["data_id"], order)


def dedup_link_timestamp(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per link name and time. Rows whose time could not be read are told apart by its text, ``_unresolved``."""
    return keep_first(df, ["name", "timestamp", *[c for c in ["_unresolved"] if c in df.columns]], order)


def dedup_observations(df: DataFrame, order: list[str], link: str = "link_id") -> DataFrame:
    """One row per (link, timestamp, polyline); unchanged when one of them is missing."""
    keys = [link, "timestamp", "polyline"]
    return keep_first(df, keys, order) if set(keys) <= set(df.columns) else df


def remove_duplicates(df: DataFrame, params: AggregationParams, order: list[str]) -> DataFrame:
    if params.remove_data_id_duplicates and "data_id" in df.columns:
        df = dedup_data_id(df, order)
    if params.remove_link_timestamp_duplicates and {"name", "timestamp"} <= set(df.columns):
        df = dedup_link_timestamp(df, order)
    return df


def clean(df: DataFrame, params: AggregationParams, order: list[str]) -> DataFrame:
    """Validity, then both deduplications."""
    return df.transform(resolve_validity, params).transform(remove_duplicates, params, order)


def cleaning_stats(df: DataFrame, params: AggregationParams, order: list[str]) -> DataFrame:
    """One row: what the cleaning chain removed and how many rows were valid."""
    before = resolve_validity(df, params).agg(
        F.count("*").alias("original_rows"), F.count_if("is_valid").alias("valid_rows")
    )
    kept_ids = clean(df, _only_data_id(params), order).agg(F.count("*").alias("n")).scalar()
    kept_all = clean(df, params, order).agg(F.count("*").alias("n")).scalar()
    return before.select(
        "original_rows",
        "valid_rows",
        (F.col("original_rows") - kept_ids).alias("data_id_duplicates"),
        (kept_ids - kept_all).alias("link_timestamp_duplicates"),
        kept_all.alias("final_rows"),
    )


def _only_data_id(params: AggregationParams) -> AggregationParams:
    from dataclasses import replace

    return replace(params, remove_link_timestamp_duplicates=False)


