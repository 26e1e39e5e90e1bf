"""Sending the package to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package's sources for every executor."""
    application = spark.sparkContext.applicationId
    if application in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="linkspark-ship-"), "linkspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("linkspark", os.path.relpath(full, PACKAGE)))
    spark.sparkContext.addPyFile(path)
    _sent.add(application)
