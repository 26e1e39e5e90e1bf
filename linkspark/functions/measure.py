"""Distances between paired lines, over whole Arrow batches.

For every vertex (or sample point) the nearest segment of the paired line is searched, in a grid of the line's
segments where these are many. The work is laid out flat, (point, segment) after (point, segment), in slices of
bounded size, so neither many rows nor one long line can exhaust a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from linkspark.functions.lines import starts_of, to_numpy

SLICE = 200_000
#: Segments of a line above which points search a grid in place of all segments.
INDEXED = 64
#: Sample points of a reference line held at once, or as many as the routes of the batch have segments.
COVERAGE_SAMPLES = 20_000
STRICT_M = 1e-6


def _segments(x, y, counts):
    """Segment ends as flat arrays and the number of segments per row."""
    inner = np.ones(max(len(x) - 1, 0), bool)
    ends = np.cumsum(counts)[:-1] - 1
    inner[ends[(ends >= 0) & (ends < len(inner))]] = False
    first = np.flatnonzero(inner)
    return (x[first], y[first], x[first + 1], y[first + 1]), np.maximum(counts - 1, 0)


def nearest(px, py, point_row, segments, segment_counts) -> np.ndarray:
    """Distance of every point to the nearest segment of its row; infinite where the row has none."""
    many = segment_counts[point_row] > INDEXED
    if not many.any():
        return _nearest_of_all(px, py, point_row, segments, segment_counts)
    out = np.empty(len(px))
    out[many] = _nearest_in_grid(px[many], py[many], point_row[many], segments, segment_counts)
    out[~many] = _nearest_of_all(px[~many], py[~many], point_row[~many], segments, segment_counts)
    return out


def _nearest_of_all(px, py, point_row, segments, segment_counts) -> np.ndarray:
    """Every point meets every segment of its row."""
    first_segment = starts_of(segment_counts)
    work = segment_counts[point_row]
    out = np.full(len(px), np.inf)
    for begin, end in _slices(work):
        n = work[begin:end]
        busy = n > 0
        n, points = n[busy], np.arange(begin, end)[busy]
        if len(points):
            offset = starts_of(n)
            p = np.repeat(points, n)
            s = np.arange(n.sum()) - np.repeat(offset, n) + np.repeat(first_segment[point_row[points]], n)
            out[points] = np.sqrt(np.minimum.reduceat(_squares(px[p], py[p], segments, s), offset))
    return out


def _squares(x, y, segments, s) -> np.ndarray:
    """Squared distance of each point to its segment ``s``."""
    x1, y1, x2, y2 = (c[s] for c in segments)
    dx, dy = x2 - x1, y2 - y1
    norm = dx * dx + dy * dy
    along = (x - x1) * dx + (y - y1) * dy
    t = np.clip(np.divide(along, norm, out=np.zeros_like(along), where=norm > 0), 0.0, 1.0)
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return ex * ex + ey * ey


def _nearest_in_grid(px, py, point_row, segments, segment_counts) -> np.ndarray:
    """The same with a uniform grid over the segments of every row.

    Segments stand in the cells of their pieces, none longer than a cell. A point looks into the nine cells around it; a
    segment within half a cell has a piece there, so what is found that near is the nearest. The others look again in a
    grid of cells twice as large, and so on.
    """
    x1, y1, x2, y2 = segments
    length = np.hypot(x2 - x1, y2 - y1)
    row_of = np.repeat(np.arange(len(segment_counts)), segment_counts)
    wanted = np.zeros(len(segment_counts), bool)
    wanted[point_row] = True
    cell = np.bincount(row_of, length, len(segment_counts)) / np.maximum(segment_counts, 1)
    extent = np.ones(len(segment_counts))
    low = [np.full(len(segment_counts), np.inf) for _ in range(2)]
    high = [np.full(len(segment_counts), -np.inf) for _ in range(2)]
    for k, (ends, points) in enumerate((((x1, x2), px), ((y1, y2), py))):
        for values, rows in ((ends[0], row_of), (ends[1], row_of), (points, point_row)):
            np.minimum.at(low[k], rows, values)
            np.maximum.at(high[k], rows, values)
        extent = np.maximum(extent, np.where(np.isfinite(high[k] - low[k]), high[k] - low[k], 1.0))
    # at most so many cells across that their numbers stay exact, also where all segments are points
    cell = np.maximum(cell, extent / 1e6)
    best = np.full(len(px), np.inf)
    live = np.flatnonzero(np.isfinite(px) & np.isfinite(py))
    best[~(np.isfinite(px) & np.isfinite(py))] = np.nan
    while len(live):
        rows = np.unique(point_row[live])
        wanted[:] = False
        wanted[rows] = True
        mine = np.flatnonzero(wanted[row_of])
        pieces = np.ceil(length[mine] / cell[row_of[mine]]).astype(np.int64) + 1
        s = np.repeat(mine, pieces)
        part = (np.arange(len(s)) - np.repeat(starts_of(pieces), pieces) + 0.5) / np.repeat(pieces, pieces)
        across = np.where(wanted, np.floor((high[0] - low[0]) / cell) + 3, 0).astype(np.int64)
        down = np.where(wanted, np.floor((high[1] - low[1]) / cell) + 3, 0).astype(np.int64)
        base = np.cumsum(across * down) - across * down

        def column(values, rows, axis):
            return np.floor((values - low[axis][rows]) / cell[rows]).astype(np.int64) + 1  # noqa: B023

        r = row_of[s]
        key = base[r] + column(x1[s] + (x2[s] - x1[s]) * part, r, 0) * down[r] + column(y1[s] + (y2[s] - y1[s]) * part, r, 1)
        order = np.argsort(key, kind="stable")
        key, s = key[order], s[order]
        r = point_row[live]
        cx, cy = column(px[live], r, 0), column(py[live], r, 1)
        for dx in (-1, 0, 1):
            # three cells of one column follow each other
            first = base[r] + (cx + dx) * down[r] + cy - 1
            begin, end = np.searchsorted(key, first), np.searchsorted(key, first + 3)
            for a, b in _slices(end - begin):
                n = (end - begin)[a:b]
                busy = n > 0
                points, n = live[a:b][busy], n[busy]
                if len(points):
                    offset = starts_of(n)
                    near = s[np.arange(n.sum()) - np.repeat(offset, n) + np.repeat(begin[a:b][busy], n)]
                    squares = _squares(np.repeat(px[points], n), np.repeat(py[points], n), segments, near)
                    best[points] = np.minimum(best[points], np.sqrt(np.minimum.reduceat(squares, offset)))
        live = live[~(best[live] <= cell[r] / 2)]
        cell = cell * 2
    return best


def _slices(work: np.ndarray):
    """Ranges of entries with about ``SLICE`` units of work, one entry at least."""
    done = np.cumsum(work)
    begin = 0
    while begin < len(work):
        limit = (done[begin - 1] if begin else 0) + SLICE
        end = max(int(np.searchsorted(done, limit, side="right")), begin + 1)
        yield begin, end
        begin = end


def _per_row_max(values, rows, n_rows):
    out = np.full(n_rows, -np.inf)
    np.maximum.at(out, rows, values)
    return out


def hausdorff_batch(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Symmetric vertex-to-line distance per row, infinite for missing or degenerate input."""
    ax, ay, an = to_numpy(a)
    bx, by, bn = to_numpy(b)
    rows = np.arange(len(an))
    a_segments, a_count = _segments(ax, ay, an)
    b_segments, b_count = _segments(bx, by, bn)
    a_row, b_row = np.repeat(rows, an), np.repeat(rows, bn)
    there = _per_row_max(nearest(ax, ay, a_row, b_segments, b_count), a_row, len(rows))
    back = _per_row_max(nearest(bx, by, b_row, a_segments, a_count), b_row, len(rows))
    both = np.maximum(there, back)
    return np.where((an >= 2) & (bn >= 2) & np.isfinite(both), both, np.inf)


def coverage_batch(route: pa.Array, reference: pa.Array, spacing: float) -> np.ndarray:
    """Share of every reference line that its route overlaps."""
    rx, ry, rn = to_numpy(reference)
    lx, ly, ln = to_numpy(route)
    (x1, y1, x2, y2), per_line = _segments(rx, ry, rn)
    length = np.hypot(x2 - x1, y2 - y1)
    steps = np.maximum(np.ceil(length / spacing), 1).astype(np.int64)
    owner = np.repeat(np.arange(len(rn)), per_line)
    ends = np.cumsum(steps)
    route_segments = _segments(lx, ly, ln)
    total, strict, loose = (np.zeros(len(rn)) for _ in range(3))
    # a slice may begin or end inside a segment, so neither many lines nor one long line fills the memory
    # a grid of many segments is laid for as many samples
    most = max(COVERAGE_SAMPLES, len(route_segments[0][0]))
    for begin in range(0, int(ends[-1]) if len(ends) else 0, most):
        sample = np.arange(begin, min(begin + most, int(ends[-1])))
        segment = np.searchsorted(ends, sample, side="right")
        part = (sample - (ends - steps)[segment] + 0.5) / steps[segment]
        px = x1[segment] + (x2 - x1)[segment] * part
        py = y1[segment] + (y2 - y1)[segment] * part
        step = length[segment] / steps[segment]
        row = owner[segment]
        distance = nearest(px, py, row, *route_segments)
        total += np.bincount(row, step, len(rn))
        strict += np.bincount(row, np.where(distance <= STRICT_M, step, 0.0), len(rn))
        loose += np.bincount(row, np.where(distance <= max(spacing, STRICT_M), step, 0.0), len(rn))
    covered = np.where(strict > 0, strict, loose)
    share = np.divide(covered, total, out=np.zeros(len(rn)), where=total > 0)
    return np.clip(share, 0.0, 1.0)


def hausdorff(a: Column, b: Column) -> Column:
    """Hausdorff distance of two line columns in their own unit."""

    @arrow_udf("double")
    def line_hausdorff(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(hausdorff_batch(left, right))

    return line_hausdorff(a, b)


def coverage(route: Column, reference: Column, spacing: float = 1.0) -> Column:
    """Share of the reference line that the route overlaps, 0 to 1.

    The reference is sampled every ``spacing`` metres. Strict overlap counts samples on the route; only
    when nothing overlaps strictly, samples within ``spacing`` of the route count. Against an exact
    overlay the share differs by at most one step per overlap boundary.
    """

    @arrow_udf("double")
    def line_coverage(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(coverage_batch(left, right, spacing))

    return line_coverage(route, reference)
