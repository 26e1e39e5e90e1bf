"""Compass bearings and octants."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkspark.functions.geometry import let

# --- fixed values: octant codes from north, clockwise; WGS84 ellipsoid ---
OCTANTS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
GEODESIC_STEPS = 20
#: Change of the longitude difference (radians) below which it has settled, and halvings of an azimuth's interval.
SETTLED, HALVINGS = 1e-11, 54


def normalize_bearing(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def octant_code(bearing: Column) -> Column:
    """1 (north) to 8 (north-west); sectors are 45 degrees wide and centred on their direction."""
    return (F.floor(F.pmod(bearing + 22.5, F.lit(360.0)) / 45.0) + 1).cast("int")


def octant_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in OCTANTS]), code)


def planar_bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Heading from north on plane coordinates, NULL for coincident points."""
    dx, dy = x2 - x1, y2 - y1
    still = (F.abs(dx) < 1e-9) & (F.abs(dy) < 1e-9)
    return F.when(~still, normalize_bearing(F.degrees(F.atan2(dx, dy))))


def angular_distance(a: Column, b: Column) -> Column:
    """Smallest separation of two bearings, 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def geodesic_azimuths(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """STRUCT<forward, back> in degrees by Vincenty's inverse solution with a fixed number of steps.

    ``forward`` is the azimuth at point 1 towards point 2, ``back`` the azimuth at point 2 towards
    point 1. Where the steps do not settle, between nearly antipodal points, the azimuth is found by
    :func:`_antipodal`. NULL for coincident points and where the latitudes are not latitudes.
    """
    f = FLATTENING
    inputs = F.struct(
        F.atan((1 - f) * F.tan(F.radians(lat1))).alias("u1"),
        F.atan((1 - f) * F.tan(F.radians(lat2))).alias("u2"),
        F.radians(F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0).alias("l"),
    )

    def solve(q: Column) -> Column:
        def step(lam: Column, _: Column) -> Column:
            sin_sigma = F.sqrt(
                F.pow(F.cos(q["u2"]) * F.sin(lam), 2)
                + F.pow(F.cos(q["u1"]) * F.sin(q["u2"]) - F.sin(q["u1"]) * F.cos(q["u2"]) * F.cos(lam), 2)
            )
            cos_sigma = F.sin(q["u1"]) * F.sin(q["u2"]) + F.cos(q["u1"]) * F.cos(q["u2"]) * F.cos(lam)
            sin_alpha = F.when(
                sin_sigma != 0, F.cos(q["u1"]) * F.cos(q["u2"]) * F.sin(lam) / sin_sigma
            ).otherwise(0.0)
            trig = F.struct(
                sin_sigma.alias("ss"), cos_sigma.alias("cs"), sin_alpha.alias("sa"),
                (1 - sin_alpha * sin_alpha).alias("c2a"),
            )

            def update(t: Column) -> Column:
                c2m = F.when(
                    t["c2a"] != 0, t["cs"] - 2 * F.sin(q["u1"]) * F.sin(q["u2"]) / t["c2a"]
                ).otherwise(0.0)
                c = f / 16 * t["c2a"] * (4 + f * (4 - 3 * t["c2a"]))
                sigma = F.atan2(t["ss"], t["cs"])
                return q["l"] + (1 - c) * f * t["sa"] * (
                    sigma + c * t["ss"] * (c2m + c * t["cs"] * (2 * c2m * c2m - 1))
                )

            return let(trig, update)

        def walk(state: Column, k: Column) -> Column:
            return F.struct(step(state["lam"], k).alias("lam"), state["lam"].alias("last"))

        start = F.struct(q["l"].alias("lam"), F.lit(float("nan")).alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(GEODESIC_STEPS)), start, walk)

    def azimuths(q: Column) -> Column:
        def settled(state: Column) -> Column:
            near = (F.abs(state["lam"] - state["last"]) < SETTLED) & (F.abs(state["lam"]) <= math.pi)
            return F.when(near, finish(state["lam"])).otherwise(_antipodal(q["u1"], q["u2"], q["l"]))

        def finish(lam: Column) -> Column:
            forward = F.atan2(
                F.cos(q["u2"]) * F.sin(lam),
                F.cos(q["u1"]) * F.sin(q["u2"]) - F.sin(q["u1"]) * F.cos(q["u2"]) * F.cos(lam),
            )
            onward = F.atan2(
                F.cos(q["u1"]) * F.sin(lam),
                F.cos(q["u1"]) * F.sin(q["u2"]) * F.cos(lam) - F.sin(q["u1"]) * F.cos(q["u2"]),
            )
            return F.struct(
                normalize_bearing(F.degrees(forward)).alias("forward"),
                normalize_bearing(F.degrees(onward) + 180.0).alias("back"),
            )

        return let(solve(q), settled)

    distinct = ~((lon1 == lon2) & (lat1 == lat2))
    usable = distinct & (F.abs(lat1) <= 90) & (F.abs(lat2) <= 90)
    return F.when(usable, let(inputs, azimuths))


def _antipodal(u1: Column, u2: Column, l: Column) -> Column:  # noqa: E741
    """STRUCT<forward, back> in degrees from reduced latitudes and the longitude difference, by halving.

    The points are mirrored so that the first is the southern one, farther from the equator than the second, and the second
    lies east of it. Then the longitude that a geodesic reaches at the second latitude grows with its first
    azimuth, from 0 to half a turn, so halving the interval of azimuths always ends at the right one.
    """
    f = FLATTENING
    swap = F.abs(u1) < F.abs(u2)
    far, other = F.when(swap, u2).otherwise(u1), F.when(swap, u1).otherwise(u2)
    mirror = F.when(far > 0, -1.0).otherwise(1.0)
    turn = F.when(l < 0, -1.0).otherwise(1.0) * F.when(swap, -1.0).otherwise(1.0)
    placed = F.struct(
        # a first point on the equator counts as south of it
        F.least(mirror * far, F.lit(-1e-150)).alias("b1"), (mirror * other).alias("b2"), F.abs(l).alias("l"),
        swap.alias("swap"), mirror.alias("mirror"), turn.alias("turn"),
    )

    def solve(q: Column) -> Column:
        def ends(azimuth: Column) -> Column:
            """Parts of the azimuth at the second point."""
            sin0 = F.sin(azimuth) * F.cos(q["b1"])
            along = F.cos(azimuth) * F.cos(q["b1"])
            gain = (F.cos(q["b2"]) - F.cos(q["b1"])) * (F.cos(q["b2"]) + F.cos(q["b1"]))
            return F.struct(sin0.alias("s0"), along.alias("c1"), F.sqrt(F.greatest(along * along + gain, F.lit(0.0))).alias("c2"))

        def reached(azimuth: Column) -> Column:
            def longitude(e: Column) -> Column:
                first = F.atan2(F.sin(q["b1"]), e["c1"])
                second = F.atan2(F.sin(q["b2"]), e["c2"])

                def span(s: Column) -> Column:
                    arc = s["second"] - s["first"]
                    omega = F.atan2(e["s0"] * F.sin(s["second"]), F.cos(s["second"])) - F.atan2(e["s0"] * F.sin(s["first"]), F.cos(s["first"]))
                    c2a = 1 - e["s0"] * e["s0"]
                    c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
                    middle = F.cos(s["first"] + s["second"])
                    return omega - (1 - c) * f * e["s0"] * (arc + c * F.sin(arc) * (middle + c * F.cos(arc) * (2 * middle * middle - 1)))

                return let(F.struct(first.alias("first"), second.alias("second")), span)

            return let(ends(azimuth), longitude)

        def halve(state: Column, _: Column) -> Column:
            middle = (state["low"] + state["high"]) / 2

            def choose(found: Column) -> Column:
                short = found < q["l"]
                return F.struct(F.when(short, middle).otherwise(state["low"]).alias("low"), F.when(short, state["high"]).otherwise(middle).alias("high"))

            return let(reached(middle), choose)

        def unfold(state: Column) -> Column:
            azimuth = (state["low"] + state["high"]) / 2

            def directions(e: Column) -> Column:
                # sine and cosine of the azimuth at either point, brought back from the mirrored place
                first = F.struct(F.sin(azimuth).alias("s"), F.cos(azimuth).alias("c"))
                second = F.struct((e["s0"] / F.cos(q["b2"])).alias("s"), (e["c2"] / F.cos(q["b2"])).alias("c"))
                side = F.when(q["swap"], -1.0).otherwise(1.0)

                def heading(v: Column) -> Column:
                    return F.degrees(F.atan2(v["s"] * side * q["turn"], v["c"] * side * q["mirror"]))

                one, two = F.when(q["swap"], second).otherwise(first), F.when(q["swap"], first).otherwise(second)
                return F.struct(normalize_bearing(heading(one)).alias("forward"), normalize_bearing(heading(two) + 180.0).alias("back"))

            return let(ends(azimuth), directions)

        interval = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi).alias("high"))
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), interval, halve), unfold)

    return let(placed, solve)
