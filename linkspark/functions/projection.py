"""Geographic to metric coordinates and back, over whole Arrow batches of lines.

Transverse Mercator by the Krueger series (n^4), with an optional seven-parameter datum shift.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from linkspark.functions.lines import LINE_TYPE, from_numpy, to_numpy

# --- fixed values: ellipsoids (semi-major axis, inverse flattening) ---
WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)


@dataclass(frozen=True)
class TransverseMercator:
    """Projection constants; ``to_wgs84`` is (dx, dy, dz [m], rx, ry, rz ["], ds [ppm]), position vector."""

    lat_0: float
    lon_0: float
    k_0: float
    x_0: float
    y_0: float
    ellipsoid: tuple[float, float] = GRS80
    to_wgs84: tuple[float, ...] | None = None


# --- fixed values: published EPSG definitions ---
CRS = {
    "EPSG:2039": TransverseMercator(
        lat_0=31.7343936111111,
        lon_0=35.2045169444444,
        k_0=1.0000067,
        x_0=219529.584,
        y_0=626907.39,
        to_wgs84=(23.772, 17.49, 17.859, -0.3132, -1.85274, 1.67299, -5.4262),
    ),
    "EPSG:32636": TransverseMercator(0.0, 33.0, 0.9996, 500000.0, 0.0, ellipsoid=WGS84),
}
WEB_MERCATOR = "EPSG:3857"
GEOGRAPHIC = "EPSG:4326"


def _eccentricity2(ellipsoid: tuple[float, float]) -> float:
    f = 1 / ellipsoid[1]
    return f * (2 - f)


def _shift(lon, lat, source: tuple[float, float], target: tuple[float, float], shift: tuple[float, ...]):
    """Geographic radians on ``source`` to ``target``; ``shift`` maps target to source cartesians."""
    dx, dy, dz, rx, ry, rz, ds = (tuple(shift) + (0.0,) * 7)[:7]
    rx, ry, rz = np.radians(np.array([rx, ry, rz]) / 3600.0)
    m = 1.0 + ds * 1e-6
    e2 = _eccentricity2(source)
    n = source[0] / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    x = (n * np.cos(lat) * np.cos(lon) - dx) / m
    y = (n * np.cos(lat) * np.sin(lon) - dy) / m
    z = (n * (1 - e2) * np.sin(lat) - dz) / m
    # inverse of the small-angle rotation is its transpose
    x, y, z = x + rz * y - ry * z, -rz * x + y + rx * z, ry * x - rx * y + z
    e2 = _eccentricity2(target)
    r = np.hypot(x, y)
    phi = np.arctan2(z, r * (1 - e2))
    for _ in range(4):
        n = target[0] / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        phi = np.arctan2(z + e2 * n * np.sin(phi), r)
    return np.arctan2(y, x), phi


def _series(crs: TransverseMercator):
    a, inverse = crs.ellipsoid
    f = 1 / inverse
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    root = 2 * np.sqrt(n) / (1 + n)
    xi = np.arctan(_conformal(np.radians(crs.lat_0), root))
    arc = xi + sum(al * np.sin(2 * j * xi) for j, al in enumerate(alpha, 1))
    return radius * crs.k_0, alpha, beta, delta, root, arc


def _conformal(lat, root):
    """Tangent of the conformal latitude."""
    s = np.sin(lat)
    return np.sinh(np.arctanh(s) - root * np.arctanh(root * s))


def _forward(lon, lat, crs: TransverseMercator):
    scale, alpha, _, _, root, arc = _series(crs)
    t = _conformal(lat, root)
    dlon = lon - np.radians(crs.lon_0)
    xi = np.arctan2(t, np.cos(dlon))
    eta = np.arctanh(np.sin(dlon) / np.sqrt(1 + t * t))
    north, east = xi, eta
    for j, al in enumerate(alpha, 1):
        north = north + al * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        east = east + al * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    return crs.x_0 + scale * east, crs.y_0 + scale * (north - arc)


def _inverse(x, y, crs: TransverseMercator):
    scale, _, beta, delta, _, arc = _series(crs)
    xi, eta = (y - crs.y_0) / scale + arc, (x - crs.x_0) / scale
    north, east = xi, eta
    for j, be in enumerate(beta, 1):
        north = north - be * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        east = east - be * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(north) / np.cosh(east))
    lat = chi + sum(de * np.sin(2 * j * chi) for j, de in enumerate(delta, 1))
    return np.radians(crs.lon_0) + np.arctan2(np.sinh(east), np.cos(north)), lat


def project(x, y, crs: str):
    """WGS84 degrees to ``crs``."""
    if crs == GEOGRAPHIC:
        return x, y
    lon, lat = np.radians(x), np.radians(y)
    if crs == WEB_MERCATOR:
        return lon * WGS84[0], np.log(np.tan(np.pi / 4 + lat / 2)) * WGS84[0]
    target = CRS[crs]
    if target.to_wgs84:
        lon, lat = _shift(lon, lat, WGS84, target.ellipsoid, target.to_wgs84)
    return _forward(lon, lat, target)


def unproject(x, y, crs: str):
    """``crs`` to WGS84 degrees."""
    if crs == GEOGRAPHIC:
        return x, y
    if crs == WEB_MERCATOR:
        return np.degrees(x / WGS84[0]), np.degrees(2 * np.arctan(np.exp(y / WGS84[0])) - np.pi / 2)
    source = CRS[crs]
    lon, lat = _inverse(x, y, source)
    if source.to_wgs84:
        lon, lat = _shift(lon, lat, source.ellipsoid, WGS84, tuple(-v for v in source.to_wgs84))
    return np.degrees(lon), np.degrees(lat)


def _mapped(transform, crs: str, line: Column) -> Column:
    @arrow_udf(LINE_TYPE)
    def transformed(lines: pa.Array) -> pa.Array:
        x, y, counts = to_numpy(lines)
        with np.errstate(invalid="ignore", divide="ignore"):
            x, y = transform(x, y, crs)
        return from_numpy(x, y, counts, lines.is_valid().to_numpy(zero_copy_only=False))

    return transformed(line)


def project_line(line: Column, crs: str | None) -> Column:
    """Line column from WGS84 degrees to ``crs``; None leaves it as it is."""
    return line if crs in (None, GEOGRAPHIC) else _mapped(project, crs, line)


def unproject_line(line: Column, crs: str | None) -> Column:
    """Line column from ``crs`` to WGS84 degrees."""
    return line if crs in (None, GEOGRAPHIC) else _mapped(unproject, crs, line)
