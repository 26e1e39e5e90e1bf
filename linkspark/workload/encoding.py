"""Encoded route text for the views; the library itself only decodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.functions.geometry import let


def encode(line: Column, precision: int = 5) -> Column:
    """Polyline text of a line column (x = longitude)."""
    scale = float(10**precision)
    start = F.struct(
        F.lit(0).cast("bigint").alias("lat"), F.lit(0).cast("bigint").alias("lon"), F.lit("").alias("text")
    )

    def chunk_text(value: Column) -> Column:
        # ten chunks of five bits cover every coordinate delta; leading zero chunks are dropped
        parts = F.transform(
            F.sequence(F.lit(0), F.lit(45), F.lit(5)), lambda s: F.call_function("shiftright", value, s)
        )
        kept = F.filter(parts, lambda v, i: (v > 0) | (i == 0))
        return let(
            kept,
            lambda k: F.array_join(
                F.transform(
                    k,
                    lambda v, i: F.chr(v.bitwiseAND(31) + F.when(i < F.size(k) - 1, 32).otherwise(0) + 63),
                ),
                "",
            ),
        )

    def chunks(delta: Column) -> Column:
        return let(let(delta, lambda d: F.when(d < 0, -2 * d - 1).otherwise(2 * d)), chunk_text)

    def step(run: Column, p: Column) -> Column:
        lat = F.round(p["y"] * scale).cast("bigint")
        lon = F.round(p["x"] * scale).cast("bigint")
        text = F.concat(run["text"], chunks(lat - run["lat"]), chunks(lon - run["lon"]))
        return F.struct(lat.alias("lat"), lon.alias("lon"), text.alias("text"))

    return F.aggregate(line, start, step)["text"]
