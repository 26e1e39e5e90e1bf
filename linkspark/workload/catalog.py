"""All registered queries."""

from linkspark.workload import aggregation, control, files, ingest, maps  # noqa: F401
from linkspark.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
