"""Batch run: direction codes of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkspark.operators import spatial
from linkspark.sources import sinks


def run(links: DataFrame, output_dir: str, crs: str | None = None, key: str | None = None) -> dict[str, str]:
    """Write attributes, straight lines, the request list and the diagnostics; returns ``{output: folder}``."""
    table = spatial.azimuth_table(spatial.drop_unusable(links), crs, key)
    return {
        "azimuths": sinks.write_parquet(table, f"{output_dir}/azimuths"),
        "crow_lines": sinks.write_geojson_lines(spatial.crow_lines(table), f"{output_dir}/crow_lines"),
        "requests": sinks.write_csv(spatial.request_table(table), f"{output_dir}/requests", ["Id"], bom=True),
        "diagnostics": sinks.write_csv(spatial.azimuth_diagnostics(table), f"{output_dir}/diagnostics"),
    }
