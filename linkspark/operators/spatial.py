"""Line tables: selection, lengths, directions, layers. ``line`` is ``ARRAY<STRUCT<x, y>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions import bearings, geometry, polyline
from linkspark.functions.lines import coordinate_text
from linkspark.functions.projection import project_line, unproject_line
from linkspark.operators.grouping import HOT_ROWS, keep_first, lookup_join
from linkspark.operators.quantiles import global_rank

# --- fixed values: least feature length (m) drawn per zoom level; resolution (m/pixel) ladder ---
MIN_FEATURE_M = {
    1: 5000, 2: 2000, 3: 1000, 4: 500, 5: 200, 6: 100, 7: 50, 8: 20, 9: 10, 10: 5, 11: 2, 12: 1, 13: 0.5, 14: 0.1,
    15: 0,
}
ZOOM_RESOLUTIONS = [1000, 500, 250, 100, 50, 25, 10, 5, 2, 1, 0.5, 0.25, 0.1, 0.05]
DEFAULT_ZOOM = 10
ID_CANDIDATES = ["keta_id", "ketaid", "link_id", "segment_id", "linkid", "id", "Id", "ID"]
VIEWPORT_MARGIN = 0.1


def lines_from_vertices(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Vertex rows ``keys, seq, x, y`` to one line per key."""
    points = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    line = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return vertices.groupBy(*keys).agg(line.alias("line"))


def explode_vertices(lines: DataFrame) -> DataFrame:
    """One row per vertex with ``seq`` from 0."""
    others = [c for c in lines.columns if c != "line"]
    return lines.select(*others, F.posexplode("line").alias("seq", "p")).select(*others, "seq", "p.x", "p.y")


def explode_segments(lines: DataFrame) -> DataFrame:
    """One row per segment with ``seq`` from 0 and its length."""
    others = [c for c in lines.columns if c != "line"]
    rows = lines.select(*others, F.posexplode(geometry.segments(F.col("line"))).alias("seq", "s"))
    length = geometry.segment_length(F.col("s"))
    return rows.select(*others, "seq", "s.x1", "s.y1", "s.x2", "s.y2", length.alias("segment_length"))


def decode_routes(df: DataFrame, column: str = "polyline", precision: int = 5) -> DataFrame:
    """Distinct encoded routes with their line; undecodable ones have a NULL line."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return distinct.withColumn("line", polyline.decode(F.col(column), precision, pinned=True))


def project(lines: DataFrame, crs: str) -> DataFrame:
    return lines.withColumn("line", project_line(F.col("line"), crs))


def unproject(lines: DataFrame, crs: str) -> DataFrame:
    return lines.withColumn("line", unproject_line(F.col("line"), crs))


def drop_unusable(lines: DataFrame) -> DataFrame:
    """Lines with at least two vertices and no missing coordinate."""
    complete = F.forall("line", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return lines.where((F.size("line") >= 2) & complete)


def with_length(lines: DataFrame) -> DataFrame:
    """``length_m``, kept when the table already has it."""
    if "length_m" in lines.columns:
        return lines
    return lines.withColumn("length_m", geometry.line_length(F.col("line")))


def _extent(line: Column, axis: str) -> tuple[Column, Column]:
    values = F.transform(line, lambda p: p[axis])
    return F.array_min(values), F.array_max(values)


def bounds(lines: DataFrame) -> DataFrame:
    """One row: extent and centre of a layer."""
    x_lo, x_hi = _extent(F.col("line"), "x")
    y_lo, y_hi = _extent(F.col("line"), "y")
    box = lines.agg(
        F.min(x_lo).alias("min_x"), F.min(y_lo).alias("min_y"), F.max(x_hi).alias("max_x"), F.max(y_hi).alias("max_y")
    )
    return box.withColumns(
        {
            "center_x": (F.col("min_x") + F.col("max_x")) / 2,
            "center_y": (F.col("min_y") + F.col("max_y")) / 2,
        }
    )


def select_polygon(lines: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Links that touch, cross or lie inside a polygon.

    The polygon is a literal, so this is a filter without a join; an extent test goes first.
    """
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    x_lo, x_hi = _extent(F.col("line"), "x")
    y_lo, y_hi = _extent(F.col("line"), "y")
    near = (x_lo <= max(xs)) & (x_hi >= min(xs)) & (y_lo <= max(ys)) & (y_hi >= min(ys))
    return lines.where(near & geometry.line_intersects_ring(F.col("line"), geometry.ring_edges(ring)))


def _covered(df: DataFrame, shape: str, cell: Column) -> DataFrame:
    """``df`` once for every grid cell (``__cx``, ``__cy``) that the extent of ``shape`` touches, with that extent."""
    x_lo, x_hi = _extent(F.col(shape), "x")
    y_lo, y_hi = _extent(F.col(shape), "y")
    placed = df.withColumns({"__x1": x_lo, "__x2": x_hi, "__y1": y_lo, "__y2": y_hi}).withColumn("__cell", cell)
    across = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.col("__cell")), F.floor(F.col(b) / F.col("__cell"))))
    known = placed.where("__x1 IS NOT NULL AND __y1 IS NOT NULL")
    return known.withColumn("__cx", across("__x1", "__x2")).withColumn("__cy", across("__y1", "__y2")).drop("__cell")


def select_zones(lines: DataFrame, zones: DataFrame, cell: float | None = None) -> DataFrame:
    """``zone_id`` and the columns of ``lines`` for every link that touches, crosses or lies inside a zone (``zone_id``, ``ring``).

    Links and zones are dealt over the cells of a grid by their extents and meet in equal cells only; of several cells
    that a pair has in common one counts, the first of the overlap of their extents, so no pair is found twice. The exact
    test is left for pairs whose extents overlap. ``cell`` is the side of a cell; by default it is the extent that nine
    of ten zones stay below. Rings need not be closed; lines and rings without vertices meet nothing; several zones of
    one id each count.
    """
    if cell is None:
        x_lo, x_hi = _extent(F.col("ring"), "x")
        y_lo, y_hi = _extent(F.col("ring"), "y")
        usual = zones.agg(F.percentile_approx(F.greatest(x_hi - x_lo, y_hi - y_lo), 0.9).alias("c")).scalar()
        side = F.greatest(F.coalesce(usual, F.lit(1.0)), F.lit(1e-9))
    else:
        side = F.lit(float(cell))
    box = ["__x1", "__x2", "__y1", "__y2"]
    a = _covered(lines, "line", side)
    b = _covered(zones.select("zone_id", "ring"), "ring", side).withColumnsRenamed({c: f"{c}z" for c in box})
    b = b.withColumn("__side", side)
    met = a.join(b, ["__cx", "__cy"])
    left, low = F.greatest("__x1", "__x1z"), F.greatest("__y1", "__y1z")
    overlap = (left <= F.least("__x2", "__x2z")) & (low <= F.least("__y2", "__y2z"))
    once = (F.floor(left / F.col("__side")) == F.col("__cx")) & (F.floor(low / F.col("__side")) == F.col("__cy"))
    exact = geometry.line_intersects_ring(F.col("line"), geometry.edges_of(F.col("ring")))
    return met.where(overlap & once).where(exact).select("zone_id", *lines.columns)


def select_box(lines: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Links that intersect a rectangle."""
    return select_polygon(lines, [(min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y)])


def select_viewport(lines: DataFrame, box: tuple[float, float, float, float], margin: float = VIEWPORT_MARGIN) -> DataFrame:
    """Links in a viewport widened by ``margin`` of its size on every side."""
    min_x, min_y, max_x, max_y = box
    dx, dy = (max_x - min_x) * margin, (max_y - min_y) * margin
    return select_box(lines, min_x - dx, min_y - dy, max_x + dx, max_y + dy)


def zoom_filter(lines: DataFrame, zoom: int) -> DataFrame:
    """Features long enough for a zoom level (1 to 15)."""
    least = MIN_FEATURE_M[max(1, min(15, zoom))]
    return lines.where(F.col("length_m") >= least) if least > 0 else lines


def zoom_for_resolution(resolution: Column) -> Column:
    """Zoom level for a map resolution in metres per pixel."""
    first, *rest = ZOOM_RESOLUTIONS
    chain = F.when(resolution > first, 1)
    for level, limit in enumerate(rest, start=2):
        chain = chain.when(resolution > limit, level)
    return chain.otherwise(15)


def optimal_zoom(lines: DataFrame, width_px: int, height_px: int) -> DataFrame:
    """Zoom level that shows a whole layer in a viewport."""
    width, height = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    resolution = F.greatest(width / width_px, height / height_px)
    zoom = F.when((width > 0) & (height > 0), zoom_for_resolution(resolution)).otherwise(DEFAULT_ZOOM)
    return bounds(lines).select("min_x", "min_y", "max_x", "max_y", zoom.alias("zoom_level"))


def priority_batches(
    lines: DataFrame, batch_size: int = 1000, priority: str = "length_m", key: str = "link_id"
) -> DataFrame:
    """Batch number by descending priority."""
    return global_rank(lines, priority, key).withColumn(
        "batch", F.floor((F.col("position") - 1) / batch_size).cast("int")
    )


def merge_parts(parts: DataFrame, key: str = "link_id") -> DataFrame:
    """Multi-part geometries ``key, part, line`` to one line each.

    Parts that chain end to start in part order are joined; otherwise the longest part stands for the
    geometry.
    """
    ordered = F.array_sort(F.collect_list(F.struct("part", "line")))
    grouped = parts.groupBy(key).agg(F.transform(ordered, lambda p: p["line"]).alias("lines"))
    gaps = F.zip_with(
        F.slice("lines", F.lit(1), F.size("lines") - 1),
        F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))),
        lambda a, b: F.element_at(a, -1) == F.element_at(b, 1),
    )
    chained = F.forall(gaps, lambda ok: ok)
    joined = F.aggregate(
        F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))),
        F.element_at("lines", 1),
        lambda acc, nxt: F.concat(acc, F.slice(nxt, F.lit(2), F.greatest(F.size(nxt) - 1, F.lit(0)))),
    )
    measured = F.transform("lines", lambda line: F.struct(geometry.line_length(line).alias("m"), line.alias("line")))
    longest = F.array_max(F.transform(measured, lambda m: m["m"]))
    pick = F.filter(measured, lambda m: m["m"] == longest)[0]["line"]
    return grouped.select(key, chained.alias("merged"), F.when(chained, joined).otherwise(pick).alias("line"))


def longest_part(parts: DataFrame, key: str = "link_id") -> DataFrame:
    """Longest part per geometry, the first one on ties."""
    measured = parts.withColumn("length_m", geometry.line_length(F.col("line")))
    return keep_first(measured, [key], [F.desc("length_m"), F.col("part")])


def id_field(columns: list[str]) -> str | None:
    """Column that identifies features, best candidate first."""
    return next((c for c in ID_CANDIDATES if c in columns), None)


def azimuth_table(lines: DataFrame, crs: str | None = None, key: str | None = None) -> DataFrame:
    """Bearings of each link's end points, their octants and the direction-coded id.

    ``line`` is geographic when ``crs`` is None, else in ``crs`` coordinates. The swapped-axis bearing is
    taken when it lies nearer to the plane heading and within 45 degrees of it.
    """
    key = key or id_field(lines.columns)
    if key is None:
        raise ValueError("no id column")
    rows = lines.where(F.size("line") >= 2)
    geographic = F.col("line") if crs is None else unproject_line(F.array(F.element_at("line", 1), F.element_at("line", -1)), crs)
    ends = rows.withColumn("__geo", geographic).withColumns(
        {
            "start_x": F.element_at("line", 1)["x"],
            "start_y": F.element_at("line", 1)["y"],
            "end_x": F.element_at("line", -1)["x"],
            "end_y": F.element_at("line", -1)["y"],
            "start_lon": F.element_at("__geo", 1)["x"],
            "start_lat": F.element_at("__geo", 1)["y"],
            "end_lon": F.element_at("__geo", -1)["x"],
            "end_lat": F.element_at("__geo", -1)["y"],
        }
    )
    c = F.col
    raw = ends.withColumns(
        {
            "__regular": bearings.geodesic_azimuths(c("start_lon"), c("start_lat"), c("end_lon"), c("end_lat")),
            "__swapped": bearings.geodesic_azimuths(c("start_lat"), c("start_lon"), c("end_lat"), c("end_lon")),
            "azi_a_pl": bearings.planar_bearing(c("start_x"), c("start_y"), c("end_x"), c("end_y")),
            "azi_b_pl": bearings.planar_bearing(c("end_x"), c("end_y"), c("start_x"), c("start_y")),
        }
    ).withColumns(
        {
            "azi_a_raw": c("__regular.forward"),
            "azi_b_raw": c("__regular.back"),
            "azi_a_sw": c("__swapped.forward"),
            "azi_b_sw": c("__swapped.back"),
        }
    )
    regular = bearings.angular_distance(c("azi_a_raw"), c("azi_a_pl"))
    swapped = bearings.angular_distance(c("azi_a_sw"), c("azi_a_pl"))
    swap = F.coalesce((swapped + 1e-9 < regular) & (swapped <= 45.0), F.lit(False))
    chosen = raw.withColumn("axis_fix", swap.cast("int")).withColumns(
        {
            "azi_a": F.when(c("axis_fix") == 1, c("azi_a_sw")).otherwise(c("azi_a_raw")),
            "azi_b": F.when(c("axis_fix") == 1, c("azi_b_sw")).otherwise(c("azi_b_raw")),
        }
    )
    coded = chosen.withColumns(
        {"code_a": bearings.octant_code(c("azi_a")), "code_b": bearings.octant_code(c("azi_b"))}
    )
    kid = c(key).cast("string")
    code = lambda column: c(column).cast("string")
    return coded.select(
        kid.alias("kid"),
        F.concat(kid, F.lit("-"), code("code_b"), code("code_a")).alias("Id"),
        "code_a", bearings.octant_name(c("code_a")).alias("dir_a"), "azi_a",
        "code_b", bearings.octant_name(c("code_b")).alias("dir_b"), "azi_b",
        "start_lat", "start_lon", "end_lat", "end_lon", "start_x", "start_y", "end_x", "end_y",
        coordinate_text(c("start_lat"), c("start_lon")).alias("start_coord"),
        coordinate_text(c("end_lat"), c("end_lon")).alias("end_coord"),
        F.concat(code("code_b"), F.lit("-"), code("code_a")).alias("travel_mode"),
        "azi_a_raw", "azi_b_raw", "azi_a_sw", "azi_b_sw", "azi_a_pl", "azi_b_pl", "axis_fix",
    )


def azimuth_diagnostics(table: DataFrame) -> DataFrame:
    """One row: how far chosen bearings lie from plane headings."""
    difference = bearings.angular_distance(F.col("azi_a"), F.col("azi_a_pl"))
    return table.agg(
        F.avg(difference).alias("avg_diff"),
        F.max(difference).alias("max_diff"),
        F.count_if(difference > 90.0).alias("flips"),
        F.sum("axis_fix").alias("axis_fixes"),
    )


def crow_lines(table: DataFrame) -> DataFrame:
    """Straight line from start to end of every link."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return table.withColumn("line", F.array(point("start_x", "start_y"), point("end_x", "end_y")))


def request_table(table: DataFrame) -> DataFrame:
    """Start-to-end request list: id, mode 0 and the two coordinates."""
    return table.select("Id", F.lit(0).alias("mode"), "start_coord", "end_coord")


def observation_geometry(
    df: DataFrame, links: DataFrame, link: str = "name", precision: int = 5, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Line of each row: its decoded route, else the reference line of its link; rows with neither go.

    Distinct routes are decoded once and looked up, also where one route belongs to very many rows.
    """
    counted = df.where(F.col("polyline").isNotNull()).groupBy("polyline").agg(F.count("*").alias("__rows"))
    routes = counted.withColumn("__route", polyline.decode(F.col("polyline"), precision))
    reference = links.select(F.col("link_id").alias("__ref"), F.col("line").alias("__reference"))
    located = lookup_join(df, routes, ["polyline"], "__rows", hot_rows)
    joined = located.join(reference, F.col(link) == F.col("__ref"), "left")
    line = F.coalesce("__route", "__reference")
    source = F.when(F.col("__route").isNotNull(), "route").otherwise("reference")
    return (
        joined.withColumns({"line": line, "geometry_source": source})
        .where(F.col("line").isNotNull())
        .drop("__route", "__ref", "__reference")
    )
