"""Geographic expressions: distances, boxes, affine grids, transverse Mercator."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def _number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres between points in degrees."""
    lon1, lat1, lon2, lat2 = map(_number, (lon1, lat1, lon2, lat2))
    up, across = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0)))) * (2 * EARTH_RADIUS_M)


def squared_degrees(lon: Column, lat: Column, x, y) -> Column:
    x, y = _number(x), _number(y)
    return (lon - x) * (lon - x) + (lat - y) * (lat - y)


def in_box(lon: Column, lat: Column, box: Sequence[float]) -> Column:
    """Inclusive on all four sides; plain range predicates, so Parquet sees them."""
    west, south, east, north = map(float, box)
    return (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)


def boxes_meet(a: Sequence[Column], b: Sequence) -> Column:
    """Whether boxes (west, south, east, north) share a point; touching counts."""
    west, south, east, north = map(_number, b)
    return (a[2] >= west) & (a[3] >= south) & (a[0] <= east) & (a[1] <= north)


def square_box(lon: float, lat: float, radius_km: float) -> list[float]:
    """Box of that half side around a point, rounded to 6 places, half to even, on
    the driver (Spark's round goes half up)."""
    metres = radius_km * 1000.0
    shrink = math.cos(math.radians(lat))
    shrink = 1e-9 if abs(shrink) < 1e-9 else shrink
    up, across = metres / METRES_PER_DEGREE, metres / (METRES_PER_DEGREE * shrink)
    return [float(round(v, 6)) for v in (lon - across, lat - up, lon + across, lat + up)]


def validate_box(box: Sequence[float]) -> list[float]:
    if box is None or len(box) != 4:
        raise ValueError("bbox must be [minLon, minLat, maxLon, maxLat].")
    west, south, east, north = map(float, box)
    if west > east or south > north:
        raise ValueError("bbox min coordinates must be <= max coordinates.")
    return [west, south, east, north]


def pixel_centre(row: Column, col: Column, affine: Sequence) -> tuple[Column, Column]:
    """Map position of a pixel's centre under (a, b, c, d, e, f)."""
    a, b, c, d, e, f = map(_number, affine)
    x, y = col + F.lit(0.5), row + F.lit(0.5)
    return c + x * a + y * b, f + x * d + y * e


# WGS 84 ellipsoid and UTM constants (fixed values)
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
MERIDIAN_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Krueger series in the third flattening (fixed values of the published expansion)
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45 + 26 * _N**5 / 45 - 2854 * _N**6 / 675,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45 + 2704 * _N**5 / 315 + 2323 * _N**6 / 945,
    56 * _N**3 / 15 - 136 * _N**4 / 35 - 1262 * _N**5 / 105 + 73814 * _N**6 / 2835,
    4279 * _N**4 / 630 - 332 * _N**5 / 35 - 399572 * _N**6 / 14175,
    4174 * _N**5 / 315 - 144838 * _N**6 / 6237,
    601676 * _N**6 / 22275,
)


@dataclass(frozen=True)
class Crs:
    """EPSG:4326 (zone 0) or a WGS 84 UTM zone."""

    epsg: int
    zone: int = 0
    south: bool = False

    @staticmethod
    def from_epsg(epsg: int) -> Crs:
        if epsg == 4326:
            return Crs(epsg)
        if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
            return Crs(epsg, epsg % 100, epsg > 32700)
        raise ValueError(f"unsupported coordinate system EPSG:{epsg}")

    @property
    def central_meridian(self) -> float:
        return self.zone * 6.0 - 183.0

    def __str__(self) -> str:
        return f"EPSG:{self.epsg}"


class _SparkMath:
    sin, cos, sinh, cosh, sqrt, atan, atan2, asin = F.sin, F.cos, F.sinh, F.cosh, F.sqrt, F.atan, F.atan2, F.asin


class _NumpyMath:
    sin, cos, sinh, cosh, sqrt = np.sin, np.cos, np.sinh, np.cosh, np.sqrt
    atan, atan2, asin = np.arctan, np.arctan2, np.arcsin


def _to_lonlat(crs: Crs, x, y, m):
    xi = (y - (FALSE_NORTHING if crs.south else 0.0)) / (UTM_SCALE * MERIDIAN_RADIUS)
    eta = (x - FALSE_EASTING) / (UTM_SCALE * MERIDIAN_RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi1 = xi1 - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        eta1 = eta1 - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(xi1) / m.cosh(eta1))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * m.sin(2 * j * chi)
    return crs.central_meridian + m.atan2(m.sinh(eta1), m.cos(xi1)) * (180.0 / math.pi), lat * (180.0 / math.pi)


def utm_to_lonlat(crs: Crs, x: Column, y: Column) -> tuple[Column, Column]:
    """Inverse transverse Mercator as Catalyst expressions; identity for 4326."""
    return (x, y) if not crs.zone else _to_lonlat(crs, x, y, _SparkMath)


def to_lonlat(crs: Crs, x, y) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.asarray(x, float), np.asarray(y, float)
    return (x, y) if not crs.zone else _to_lonlat(crs, x, y, _NumpyMath)


def from_lonlat(crs: Crs, lon, lat) -> tuple[np.ndarray, np.ndarray]:
    """Forward transverse Mercator."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if not crs.zone:
        return lon, lat
    e = 2 * math.sqrt(_N) / (1 + _N)
    s, away = np.sin(np.radians(lat)), np.radians(lon - crs.central_meridian)
    t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    xi1, eta1 = np.arctan2(t, np.cos(away)), np.arctanh(np.sin(away) / np.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for j, a in enumerate(ALPHA, 1):
        xi = xi + a * np.sin(2 * j * xi1) * np.cosh(2 * j * eta1)
        eta = eta + a * np.cos(2 * j * xi1) * np.sinh(2 * j * eta1)
    scale = UTM_SCALE * MERIDIAN_RADIUS
    return FALSE_EASTING + scale * eta, (FALSE_NORTHING if crs.south else 0.0) + scale * xi


def lonlat_bounds(crs: Crs, west: float, south: float, east: float, north: float, points: int = 21) -> tuple[float, float, float, float]:
    """Bounds of a map rectangle in degrees, from its edges with that many points
    between the corners of each."""
    xs, ys = np.linspace(west, east, points + 2), np.linspace(south, north, points + 2)
    x = np.concatenate((xs, xs, np.full_like(ys, west), np.full_like(ys, east)))
    y = np.concatenate((np.full_like(xs, south), np.full_like(xs, north), ys, ys))
    lon, lat = to_lonlat(crs, x, y)
    return float(lon.min()), float(lat.min()), float(lon.max()), float(lat.max())
