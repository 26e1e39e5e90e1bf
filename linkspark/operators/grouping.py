"""Skew-safe building blocks: keep-first, per-group facts on every row, lookups with hot keys.

A *hot* key is one with more than ``hot_rows`` rows. At most ``rows / hot_rows`` keys can be hot; only these
keys, with their counts and aggregates, are broadcast, never what a lookup carries. Every other key is small enough
for one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key by ``order``.

    ``row_number() = 1`` is limited map-side before the shuffle, so a big group of copies shrinks to one
    row per task first.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def with_group_stats(
    df: DataFrame, keys: list[str], stats: dict[str, Column], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Append per-group aggregates to every row (rows with a NULL key get them as a group of their own).

    Hot groups take their aggregates from a broadcast of the few hot keys, and each of their rows is a window of
    its own; all other groups use one window over ``keys``.
    """
    facts = [agg.alias(f"__hot_{name}") for name, agg in stats.items()]
    hot_keys = [F.col(k).alias(f"__key_{k}") for k in keys]
    hot = df.groupBy(*keys).agg(F.count("*").alias("__n"), *facts).where(F.col("__n") > hot_rows)
    hot = hot.select(*hot_keys, *[f"__hot_{name}" for name in stats], "__n")
    on = _null_safe(keys)
    tagged = df.join(F.broadcast(hot), on, "left")
    salt = F.when(F.col("__n").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(0)
    tagged = tagged.withColumn("__salt", salt)
    window = Window.partitionBy(*keys, "__salt")
    facts = [
        F.when(F.col("__n").isNotNull(), F.col(f"__hot_{name}")).otherwise(agg.over(window)).alias(name)
        for name, agg in stats.items()
    ]
    return tagged.select(*[F.col(c) for c in df.columns], *facts)


def lookup_join(
    df: DataFrame, lookup: DataFrame, keys: list[str], rows_column: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join to a table that is unique on ``keys`` and knows how many ``df`` rows each key has.

    Rows of a hot key are dealt over as many salts as it has portions of ``hot_rows``, and its lookup row is
    repeated for each of them. Rows with a NULL key match nothing; each gets a salt of its own.
    """
    values = [c for c in lookup.columns if c not in keys and c != rows_column]
    portions = F.greatest(F.lit(1), F.ceil(F.col(rows_column) / hot_rows)).cast("long")
    hot = lookup.where(F.col(rows_column) > hot_rows).select(*[F.col(k).alias(f"__key_{k}") for k in keys], portions.alias("__salts"))
    dealt = lookup.select(*keys, *values, F.explode(F.sequence(F.lit(0).cast("long"), portions - 1)).alias("__salt"))
    plain = [F.col(k) == F.col(f"__key_{k}") for k in keys]
    unmatched = F.lit(False)
    for k in keys:
        unmatched = unmatched | F.col(k).isNull()
    number = F.monotonically_increasing_id()
    salt = F.when(unmatched, -1 - number).otherwise(F.pmod(number, F.coalesce("__salts", F.lit(1).cast("long"))))
    tagged = df.join(F.broadcast(hot), plain, "left").withColumn("__salt", salt)
    joined = tagged.select(*df.columns, "__salt").join(dealt, [*keys, "__salt"], "left")
    return joined.select(*[F.col(c) for c in df.columns], *values)


def _null_safe(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return on
