"""Map coordinates as columns: transverse Mercator and Lambert conformal conic, forward and inverse, metres and degrees.

Transverse Mercator by Krueger's series to the fourth power of the third flattening (below a micrometre inside a zone).
The conic on an ellipsoid is closed forward; its inverse takes STEPS fixed-point steps, each of which gains over two
digits. On a sphere (eccentricity 0) one step is exact. Null coordinates stay null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the UTM scale, false easting and southern false northing.
A, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
EAST, SOUTH = 500_000.0, 10_000_000.0

STEPS = 6

_N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)
RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)  #: of the rectifying sphere
# Coefficients of Krueger's series.
FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280,
)
INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280,
)
LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630,
)


def _add(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def utm_zone(longitude: Column) -> Column:
    """Zone 1 .. 60 by longitude alone (no exceptions of the far north)."""
    return F.pmod(F.floor((longitude + 180) / 6), F.lit(60)).cast("int") + 1


def utm(longitude: Column, latitude: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone; southern latitudes have the false northing of the south."""
    sine, away = F.sin(F.radians(latitude)), F.radians(longitude - (zone * 6 - 183))
    t = F.sinh(F.atanh(sine) - ECCENTRICITY * F.atanh(ECCENTRICITY * sine))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    north = _add([xi, *(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(FORWARD, 1))])
    east = _add([eta, *(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(FORWARD, 1))])
    return SCALE * RADIUS * east + EAST, SCALE * RADIUS * north + F.when(latitude < 0, SOUTH).otherwise(0.0)


def utm_inverse(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a point of a zone."""
    xi = (northing - F.when(south, SOUTH).otherwise(0.0)) / (SCALE * RADIUS)
    eta = (easting - EAST) / (SCALE * RADIUS)
    x = _add([xi, *(-b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(INVERSE, 1))])
    e = _add([eta, *(-b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(INVERSE, 1))])
    chi = F.asin(F.sin(x) / F.cosh(e))
    phi = _add([chi, *(d * F.sin(2 * j * chi) for j, d in enumerate(LATITUDE, 1))])
    return F.degrees(F.atan2(F.sinh(e), F.cos(x))) + zone * 6 - 183, F.degrees(phi)


@dataclass(frozen=True)
class Conic:
    """A Lambert conformal conic: standard parallels and origin in degrees, radius and eccentricity of the figure."""

    first: float
    second: float
    latitude: float
    longitude: float
    radius: float = A
    eccentricity: float = ECCENTRICITY

    def _t(self, degrees: float) -> float:
        phi = math.radians(degrees)
        s = self.eccentricity * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) * ((1 + s) / (1 - s)) ** (self.eccentricity / 2)

    def _m(self, degrees: float) -> float:
        phi = math.radians(degrees)
        return math.cos(phi) / math.sqrt(1 - (self.eccentricity * math.sin(phi)) ** 2)

    @property
    def cone(self) -> float:
        if math.isclose(self.first, self.second):
            return math.sin(math.radians(self.first))
        return math.log(self._m(self.first) / self._m(self.second)) / math.log(self._t(self.first) / self._t(self.second))

    @property
    def reach(self) -> float:
        """Radius times the scale of the cone."""
        return self.radius * self._m(self.first) / (self.cone * self._t(self.first) ** self.cone)

    @property
    def origin(self) -> float:
        return self.reach * self._t(self.latitude) ** self.cone

    def forward(self, longitude: Column, latitude: Column) -> tuple[Column, Column]:
        phi = F.radians(latitude)
        s = self.eccentricity * F.sin(phi)
        t = F.tan(math.pi / 4 - phi / 2) * F.pow((1 + s) / (1 - s), F.lit(self.eccentricity / 2))
        rho = self.reach * F.pow(t, F.lit(self.cone))
        theta = self.cone * F.radians(F.pmod(longitude - self.longitude + 180, F.lit(360.0)) - 180)
        return rho * F.sin(theta), self.origin - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        sign = 1.0 if self.cone > 0 else -1.0
        rho = F.hypot(x, self.origin - y)
        theta = F.atan2(sign * x, sign * (self.origin - y))
        t = F.pow(rho / abs(self.reach), F.lit(1 / self.cone))
        phi = math.pi / 2 - 2 * F.atan(t)
        for _ in range(STEPS if self.eccentricity else 0):
            s = self.eccentricity * F.sin(phi)
            phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(self.eccentricity / 2)))
        return F.degrees(theta / self.cone) + self.longitude, F.degrees(phi)
