"""Transverse Mercator in metres and back, as column expressions: the series in the third flattening to its fourth power."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid, and scale and offset of the universal zones.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST = 0.9996, 500000.0

N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = sqrt(FLATTENING * (2 - FLATTENING))
MERIDIAN = RADIUS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Coefficients of the series forwards, backwards, and from conformal to geographic latitude.
FORWARD = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280]
BACKWARD = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280]
LATITUDE = [2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630]


def meridian(zone: int) -> float:
    """The middle longitude of a universal zone."""
    return 6.0 * zone - 183.0


def to_metres(lon: Column, lat: Column, zone: int) -> Column:
    """A struct (x, y) of east and north in metres; north of the equator."""
    phi, lam = F.radians(lat), F.radians(lon - meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(FORWARD, start=1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.struct((EAST + SCALE * MERIDIAN * east).alias("x"), (SCALE * MERIDIAN * north).alias("y"))


def to_degrees(x: Column, y: Column, zone: int) -> Column:
    """A struct (lon, lat) of what `to_metres` gives."""
    xi, eta = y / (SCALE * MERIDIAN), (x - EAST) / (SCALE * MERIDIAN)
    north, east = xi, eta
    for j, b in enumerate(BACKWARD, start=1):
        north = north - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    phi = chi
    for j, d in enumerate(LATITUDE, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct((meridian(zone) + F.degrees(F.atan2(F.sinh(east), F.cos(north)))).alias("lon"), F.degrees(phi).alias("lat"))


def metres_sql(lon: str, lat: str, zone: int) -> tuple[str, str]:
    """x and y of `to_metres` in DuckDB SQL."""
    phi, lam = f"radians({lat})", f"radians({lon} - {meridian(zone)})"
    e = f"{ECCENTRICITY!r}::DOUBLE"
    t = f"sinh(atanh(sin({phi})) - {e} * atanh({e} * sin({phi})))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + pow({t}, 2)))"
    north = " + ".join([xi] + [f"{a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(FORWARD, start=1)])
    east = " + ".join([eta] + [f"{a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(FORWARD, start=1)])
    size = f"{SCALE * MERIDIAN!r}::DOUBLE"
    return f"({EAST} + {size} * ({east}))", f"({size} * ({north}))"
