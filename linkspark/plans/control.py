"""Batch run: validation of observations against a network, with report and extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.config import CompletenessParams, ValidationParams
from linkspark.functions.labels import repair_label
from linkspark.functions.projection import project_line
from linkspark.operators import control, spatial
from linkspark.sources import sinks


def metric_links(links: DataFrame, params: ValidationParams, links_crs: str | None = "EPSG:4326") -> DataFrame:
    """Network lines in the metric system of the run."""
    if links_crs == params.crs_metric or params.crs_metric is None:
        return links
    geographic = spatial.unproject(links, links_crs) if links_crs not in (None, "EPSG:4326") else links
    return geographic.withColumn("line", project_line(F.col("line"), params.crs_metric))


def repair_labels(df: DataFrame, decode_bytes: bool = False) -> DataFrame:
    """Repair the two label columns where they exist."""
    present = [c for c in ("day_in_week", "day_type") if c in df.columns]
    return df.withColumns({c: repair_label(F.col(c), decode_bytes) for c in present}) if present else df


def run(
    spark: SparkSession,
    observations: DataFrame,
    links: DataFrame,
    output_dir: str,
    params: ValidationParams = ValidationParams(),
    schedule: CompletenessParams | None = None,
    links_crs: str | None = "EPSG:4326",
    order: str = "data_id",
) -> dict[str, str]:
    """Validate and write all outputs; returns ``{output: folder}``.

    Validated rows, and the failed ones among them, are written first and read back, so every extract starts from measured rows. Map
    layers keep geographic coordinates where the network has them.
    """
    out = {name: f"{output_dir}/{name}" for name in (
        "validated", "failed", "validated_csv", "best_valid_csv", "failed_csv", "no_data_csv", "link_report_csv",
        "code_histogram_csv", "link_report_layer", "failed_layer", "failed_routes_layer", "failed_reference_layer",
        "no_data_layer", "run_config",
    )}
    validated = control.validate(repair_labels(observations), metric_links(links, params, links_crs), params)
    sinks.write_parquet(validated, out["validated"])
    rows = spark.read.parquet(out["validated"])
    sinks.write_parquet(control.failed_geometry(rows), out["failed"])
    failed = spark.read.parquet(out["failed"])
    no_data = control.no_data_links(rows, links)
    report = control.link_report(rows, links, [order], schedule)
    shapes = links.select("link_id", "line")

    sinks.write_extract_csv(rows, out["validated_csv"])
    sinks.write_extract_csv(control.best_valid(rows, [order]), out["best_valid_csv"])
    sinks.write_extract_csv(failed.withColumn("failure_reason", control.failure_reason(failed)), out["failed_csv"])
    sinks.write_extract_csv(no_data, out["no_data_csv"])
    flat = sinks.report_columns(report)
    sinks.write_csv(flat, out["link_report_csv"], ["From", "To"], bom=True, numbers=sinks.significant)
    sinks.write_csv(control.code_histogram(rows), out["code_histogram_csv"], ["valid_code"])
    sinks.write_geojson_lines(sinks.short_names(report), out["link_report_layer"])
    located = spatial.observation_geometry(failed, links, precision=params.polyline_precision)
    sinks.write_geojson_lines(located, out["failed_layer"])
    unique = control.unique_routes(failed, [order])
    routes = unique.join(spatial.decode_routes(unique, precision=params.polyline_precision), "polyline")
    sinks.write_geojson_lines(routes.where(F.col("line").isNotNull()), out["failed_routes_layer"])
    periods = control.failure_periods(failed, links, order)
    sinks.write_geojson_lines(periods.join(shapes, "link_id"), out["failed_reference_layer"])
    sinks.write_geojson_lines(no_data.join(shapes, "link_id"), out["no_data_layer"])
    sinks.write_run_config(spark, params, out["run_config"], schedule=str(schedule))
    if schedule:
        missing = control.missing_observations(rows, schedule)
        out["missing_csv"] = sinks.write_extract_csv(missing, f"{output_dir}/missing_csv")
        layer = missing.join(shapes, "link_id")
        out["missing_layer"] = sinks.write_geojson_lines(layer, f"{output_dir}/missing_layer")
    return out
