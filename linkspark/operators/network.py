"""Joins between the reference network and rollups, and the audit of those joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions.text import link_key


def with_link_key(links: DataFrame, from_col: str = "from_id", to_col: str = "to_id") -> DataFrame:
    return links.withColumn("link_id", link_key(F.col(from_col), F.col(to_col)))


def join_network(links: DataFrame, results: DataFrame, how: str = "left") -> DataFrame:
    """Network rows with their results; the side that is small enough is broadcast by the planner."""
    return links.join(results, "link_id", how)


def _keys(df: DataFrame) -> DataFrame:
    return df.select("link_id").where("link_id IS NOT NULL").distinct()


def missing_in_network(links: DataFrame, results: DataFrame) -> DataFrame:
    """Result links that the network does not have."""
    return _keys(results).join(links.select("link_id"), "link_id", "left_anti")


def missing_in_results(links: DataFrame, results: DataFrame) -> DataFrame:
    return _keys(links).join(_keys(results), "link_id", "left_anti")


def keys_in_both(links: DataFrame, results: DataFrame) -> DataFrame:
    return _keys(links).intersect(_keys(results))


def keys_in_one(links: DataFrame, results: DataFrame) -> DataFrame:
    """Link ids on one side only, with the side they are missing on."""
    absent = _keys(results).subtract(_keys(links)).withColumn("missing_in", F.lit("network"))
    return absent.unionByName(_keys(links).subtract(_keys(results)).withColumn("missing_in", F.lit("results")))


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns a part lacks are NULL."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: total, distinct and duplicate full rows."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return counted.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_records"),
        F.count("*").alias("distinct_records"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_records"),
    )


def duplicate_keys(df: DataFrame, keys: list[str] = ["link_id", "date", "hour"]) -> DataFrame:
    """One row: rows, key combinations and links that occur more than once per key."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    per_link = repeated.groupBy("link_id").agg(F.sum("n").alias("rows"), F.count("*").alias("combinations"))
    return per_link.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("duplicate_records"),
        F.coalesce(F.sum("combinations"), F.lit(0)).alias("duplicate_combinations"),
        F.count("link_id").alias("links_with_duplicates"),
    )


def match_counts(links: DataFrame, results: DataFrame) -> DataFrame:
    """One row: keys on each side, matches, misses and the success rate."""
    left = _keys(links).withColumn("in_network", F.lit(1))
    right = _keys(results).withColumn("in_results", F.lit(1))
    both = left.join(right, "link_id", "full_outer")
    network, result = F.col("in_network").isNotNull(), F.col("in_results").isNotNull()
    counted = both.agg(
        F.count_if(network).alias("network_keys"),
        F.count_if(result).alias("result_keys"),
        F.count_if(network & result).alias("matched"),
        F.count_if(~network).alias("missing_in_network"),
        F.count_if(~result).alias("missing_in_results"),
    )
    rate = F.when(
        F.col("network_keys") > 0, F.col("matched") * 100.0 / F.col("network_keys")
    ).otherwise(0.0)
    return counted.withColumn("join_success_rate", rate)


def join_audit(links: DataFrame, results: DataFrame) -> DataFrame:
    """One row: the match counts, the duplicates on both sides and the resulting advice."""
    network = links.groupBy("link_id").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("features"), F.sum(F.col("n") - 1).alias("duplicates")
    )
    records = results.agg(
        F.count("*").alias("records"), F.count_if(F.col("link_id").isNull()).alias("null_links")
    )
    repeated = duplicate_keys(results)
    one = lambda df, column: df.select(column).scalar()
    audit = match_counts(links, results).withColumns(
        {
            "network_features": one(network, "features"),
            "network_duplicates": one(network, "duplicates"),
            "result_records": one(records, "records"),
            "null_link_ids": one(records, "null_links"),
            "duplicate_records": one(repeated, "duplicate_records"),
            "duplicate_combinations": one(repeated, "duplicate_combinations"),
            "links_with_duplicates": one(repeated, "links_with_duplicates"),
        }
    )
    return audit.withColumn("recommendations", _advice())


def _advice() -> Column:
    # fixed values: advice texts
    rate = F.col("join_success_rate")
    say = lambda layout, column: F.format_string(layout, F.col(column))
    return F.concat_ws(
        "; ",
        F.when(rate < 50, "Low join success rate - verify link_id format matches s_From-To pattern").when(
            rate < 80, "Moderate join success rate - review missing links for data completeness"
        ),
        F.when(
            F.col("missing_in_network") > 0,
            say("Consider updating shapefile - %d result links have no geometry", "missing_in_network"),
        ),
        F.when(
            F.col("missing_in_results") > 0,
            say("Consider data collection - %d shapefile links have no results", "missing_in_results"),
        ),
        F.when(
            F.col("duplicate_records") > 0,
            say("Remove %d duplicate records before analysis", "duplicate_records"),
        ),
    )
