"""Registration of queries and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.workload.views import CTES, Views

RECURSION = "-- recursive"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: str = "", sql: str | None = None, digits: int = 6, dates: str = ""):
    """Register a function of :class:`Views`.

    Doubles of its result are rounded to ``digits`` and dates become ISO text, so that results of two
    engines compare exactly; ``dates`` names the date columns of the SQL.
    """

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(Views(spark, sf_dir)), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            text = sql
            if dates:
                casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split())
                text = f"SELECT * REPLACE ({casts}) FROM (\n{sql.strip()}\n)"
            ORACLES[name] = with_ctes(uses.split(), text)
        return fn

    return register


def comparable(df: DataFrame, digits: int) -> DataFrame:
    changed = {c: F.round(c, digits) for c, t in df.dtypes if t == "double"}
    changed |= {c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"}
    return df.withColumns(changed) if changed else df


def with_ctes(names: list[str], body: str) -> str:
    """``WITH`` clause of the named views and all they build on, then the statement."""
    wanted: list[str] = []

    def need(name: str) -> None:
        if name in wanted:
            return
        for other in CTES:
            if other != name and f"{{{other}}}" in CTES[name]:
                need(other)
        wanted.append(name)

    for name in names:
        need(name)
    plain = {n: n for n in CTES}
    ctes = ",\n".join(f"{n} AS ({CTES[n].format(**plain).strip()})" for n in wanted)
    keyword = "WITH RECURSIVE" if RECURSION in body else "WITH"
    return f"{keyword} {ctes}\n{body.strip()}" if wanted else body.strip()


def work_folder(spark: SparkSession) -> str:
    """Fresh folder for a query that writes and reads back: shared storage where the session names one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and (not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/linkspark-{uuid4().hex}" if base else tempfile.mkdtemp(prefix="linkspark-")
