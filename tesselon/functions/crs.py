"""Transverse Mercator on the GRS80 ellipsoid, by Krueger's series to the fourth order, as column expressions.

The two Korean systems share a datum, so one is carried to the other through longitude and latitude, to well below a
millimetre within a few degrees of the central meridian.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLATTENING = 6378137.0, 1 / 298.257222101
N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280]
BETA = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280]
DELTA = [2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630]
E = 2 * math.sqrt(N) / (1 + N)


@dataclass(frozen=True)
class Mercator:
    latitude: float
    longitude: float
    scale: float
    east: float
    north: float

    def origin(self) -> float:
        """Length of the meridian from the equator to the origin's latitude."""
        s = math.sin(math.radians(self.latitude))
        t = math.sinh(math.atanh(s) - E * math.atanh(E * s))
        xi = math.atan(t)
        return RADIUS * (xi + sum(a * math.sin(2 * (k + 1) * xi) for k, a in enumerate(ALPHA)))


EPSG_5179 = Mercator(38, 127.5, 0.9996, 1_000_000, 2_000_000)
EPSG_5186 = Mercator(38, 127, 1.0, 200_000, 600_000)


def to_degrees(crs: Mercator, x: Column, y: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of planar coordinates."""
    xi = ((y - crs.north) / crs.scale + crs.origin()) / RADIUS
    eta = (x - crs.east) / (crs.scale * RADIUS)
    u, v = xi, eta
    for k, b in enumerate(BETA):
        m = 2 * (k + 1)
        u = u - b * F.sin(m * xi) * F.cosh(m * eta)
        v = v - b * F.cos(m * xi) * F.sinh(m * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    latitude = chi
    for k, d in enumerate(DELTA):
        latitude = latitude + d * F.sin(2 * (k + 1) * chi)
    return crs.longitude + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(latitude)


def from_degrees(crs: Mercator, longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """Planar coordinates of (longitude, latitude)."""
    s = F.sin(F.radians(latitude))
    t = F.sinh(F.atanh(s) - E * F.atanh(E * s))
    turn = F.radians(longitude - crs.longitude)
    u, v = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn)))
    xi, eta = u, v
    for k, a in enumerate(ALPHA):
        m = 2 * (k + 1)
        xi = xi + a * F.sin(m * u) * F.cosh(m * v)
        eta = eta + a * F.cos(m * u) * F.sinh(m * v)
    return crs.east + crs.scale * RADIUS * eta, crs.north + crs.scale * (RADIUS * xi - crs.origin())


def transformed(source: Mercator, target: Mercator, x: Column, y: Column) -> tuple[Column, Column]:
    return from_degrees(target, *to_degrees(source, x, y))
