"""Planar geometry on ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>`` columns.

A line is short (its encoded text is one string), so measuring it inside one row needs neither a
shuffle nor a vertex-pair explosion: the nested loops below are higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def segments(line: Column) -> Column:
    """Consecutive vertex pairs as ``ARRAY<STRUCT<x1, y1, x2, y2>>``."""
    return F.zip_with(
        F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))),
        F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))),
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def _fold_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def line_length(line: Column) -> Column:
    """Sum of segment lengths."""
    return _fold_sum(F.transform(segments(line), segment_length))


def segment_length(seg: Column) -> Column:
    dx, dy = seg["x2"] - seg["x1"], seg["y2"] - seg["y1"]
    return F.sqrt(dx * dx + dy * dy)


def length_pass(route_length: Column, ref_length: Column, params) -> Column:
    """Length test; links shorter than the minimum length pass untested."""
    if params.length_check_mode == "ratio":
        ratio = route_length / F.when(ref_length > 0, ref_length)
        tested = F.coalesce(ratio.between(params.length_ratio_min, params.length_ratio_max), F.lit(False))
    elif params.length_check_mode == "exact":
        tested = F.abs(route_length - ref_length) <= params.epsilon_length_m
    else:
        tested = F.lit(True)
    return F.when(ref_length >= params.min_link_length_m, tested).otherwise(F.lit(True))


def length_similar(route_length: Column, ref_length: Column, mode: str, params) -> Column:
    """Stand-alone length comparison, with wider bounds on short links."""
    if mode == "off":
        return F.lit(True)
    short = ref_length < params.min_link_length_m
    if mode == "ratio":
        ratio = route_length / F.when(ref_length > 0, ref_length)
        wide = ratio.between(max(0.0, params.length_ratio_min - 0.05), params.length_ratio_max + 0.05)
        tested = F.when(short, wide).otherwise(ratio.between(params.length_ratio_min, params.length_ratio_max))
    elif mode == "exact":
        slack = max(params.epsilon_length_m, 0.01 * params.min_link_length_m)
        tested = F.abs(route_length - ref_length) <= F.when(short, slack).otherwise(params.epsilon_length_m)
    else:
        return F.lit(False)
    return F.when(ref_length <= 0, F.abs(route_length) <= params.epsilon_length_m).otherwise(tested)


def _side(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _within(ax, ay, bx, by, px, py):
    return px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))


def segments_cross(s: Column, t: Column) -> Column:
    """True when two segments share a point."""
    d1 = _side(t["x1"], t["y1"], t["x2"], t["y2"], s["x1"], s["y1"])
    d2 = _side(t["x1"], t["y1"], t["x2"], t["y2"], s["x2"], s["y2"])
    d3 = _side(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"])
    d4 = _side(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"])
    proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    touch = (
        ((d1 == 0) & _within(t["x1"], t["y1"], t["x2"], t["y2"], s["x1"], s["y1"]))
        | ((d2 == 0) & _within(t["x1"], t["y1"], t["x2"], t["y2"], s["x2"], s["y2"]))
        | ((d3 == 0) & _within(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"]))
        | ((d4 == 0) & _within(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"]))
    )
    return proper | touch


def point_in_ring(px: Column, py: Column, ring_segments: Column) -> Column:
    """Even-odd rule."""
    crossings = F.filter(
        ring_segments,
        lambda e: ((e["y1"] > py) != (e["y2"] > py))
        & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
    )
    return F.size(crossings) % 2 == 1


def ring_edges(points: list[tuple[float, float]]) -> Column:
    """Edges of a closed ring of literal points; constant, so evaluated once."""
    closed = list(points) + ([] if points[0] == points[-1] else [points[0]])
    edges = [
        F.struct(
            F.lit(float(x1)).alias("x1"), F.lit(float(y1)).alias("y1"),
            F.lit(float(x2)).alias("x2"), F.lit(float(y2)).alias("y2"),
        )
        for (x1, y1), (x2, y2) in zip(closed, closed[1:])
    ]
    return F.array(*edges)


def edges_of(ring: Column) -> Column:
    """Edges of a ring column (vertices), closed where its last vertex is not its first."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    closed = (first["x"] == last["x"]) & (first["y"] == last["y"])
    return segments(F.when(closed, ring).otherwise(F.concat(ring, F.array(first))))


def line_intersects_ring(line: Column, edges: Column) -> Column:
    """True when the line touches, crosses or lies inside the polygon with these edges."""
    first = F.element_at(line, 1)
    crossing = F.exists(segments(line), lambda s: F.exists(edges, lambda e: segments_cross(s, e)))
    return point_in_ring(first["x"], first["y"], edges) | crossing


def first_point(line: Column) -> Column:
    return F.element_at(line, 1)


def last_point(line: Column) -> Column:
    return F.element_at(line, -1)


def number_text(x: Column) -> Column:
    """Text of a double with plain decimals and one of them at least; below 1e-4 and from 1e16 on it has an exponent.

    The cast to text writes an exponent from 1e7 on and below 1e-3.
    """
    plain = F.regexp_replace(x.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    written = (F.abs(x) >= 1e7) & (F.abs(x) < 1e16) | (F.abs(x) >= 1e-4) & (F.abs(x) < 1e-3)
    return F.when(written, plain).otherwise(x.cast("string"))


def to_wkt(line: Column) -> Column:
    """``LINESTRING (x y, ...)``."""
    points = F.transform(line, lambda p: F.concat_ws(" ", number_text(p["x"]), number_text(p["y"])))
    return F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")"))


def from_wkt(wkt: Column) -> Column:
    """Line of a ``LINESTRING`` text; NULL for anything else."""
    body = F.nullif(F.regexp_extract(wkt, r"(?i)^\s*LINESTRING\s*Z?\s*\(([^()]*)\)\s*$", 1), F.lit(""))
    return F.transform(
        F.split(F.trim(body), r"\s*,\s*"),
        lambda p: _point(
            F.split(p, r"\s+")[0].try_cast("double"),
            F.split(p, r"\s+")[1].try_cast("double"),
        ),
    )
