"""Map data: a rollup, filtered and joined to the network."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkspark.operators import classify, filters, network, rollup, spatial


def prepare(
    links: DataFrame, results: DataFrame, dates=None, hours=None, attributes: dict | None = None, polygon=None
) -> DataFrame:
    """Network with results after temporal, attribute and spatial selection.

    Results are filtered before the join and lines before it too, so each side reaches the join small.
    """
    selected = filters.by_map_time(rollup.to_map_columns(results), dates, hours)
    shapes = spatial.select_polygon(links, polygon) if polygon else links
    joined = network.join_network(shapes, selected)
    return filters.by_attributes(joined, attributes or {})


def hour_map(links: DataFrame, hourly: DataFrame, day, hour: int, metric: str = "duration") -> DataFrame:
    """Links of one date and hour with their colour class."""
    rows = filters.map_slice(rollup.to_map_columns(hourly), day, hour)
    return classify.traffic_class(network.join_network(links, rows, "inner"), metric)


def week_map(links: DataFrame, weekly: DataFrame, hour: int, daytype: str = "all", metric: str = "duration") -> DataFrame:
    """Links of one hour of the weekly profile with their colour class."""
    rows = filters.weekly_slice(rollup.to_map_columns(weekly), hour, daytype)
    return classify.traffic_class(network.join_network(links, rows, "inner"), metric)


def for_rendering(links: DataFrame, zoom: int, viewport=None, batch_size: int = 1000) -> DataFrame:
    """Features of a viewport that a zoom level shows, in batches of falling length."""
    shown = spatial.with_length(links)
    if viewport:
        shown = spatial.select_viewport(shown, viewport)
    return spatial.priority_batches(spatial.zoom_filter(shown, zoom), batch_size)
