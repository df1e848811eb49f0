"""lon/lat <-> New York Long Island state-plane feet (Lambert conformal conic,
two standard parallels, GRS80), as Column math (Snyder 1987, USGS PP 1395)."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed projection parameters (EPSG:2263 definition).
A = 6378137.0
INV_F = 298.257222101
LAT1, LAT2 = 41.0 + 2.0 / 60, 40.0 + 40.0 / 60
LAT0, LON0 = 40.0 + 10.0 / 60, -74.0
FALSE_EASTING_M = 300000.0
FALSE_NORTHING_M = 0.0
FT_PER_M = 3937.0 / 1200.0

_f = 1 / INV_F
E2 = 2 * _f - _f * _f
E = math.sqrt(E2)


def _m(phi):
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


def _t(phi):
    s = math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - E * s) / (1 + E * s)) ** (E / 2)


_p1, _p2, _p0 = (math.radians(v) for v in (LAT1, LAT2, LAT0))
N = (math.log(_m(_p1)) - math.log(_m(_p2))) / (math.log(_t(_p1)) - math.log(_t(_p2)))
AF = A * _m(_p1) / (N * _t(_p1) ** N)
RHO0 = AF * _t(_p0) ** N


def to_state_plane(lon: Column, lat: Column):
    """(x_ft, y_ft) Columns from degrees."""
    phi = F.radians(lat)
    s = F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - E * s) / (1 + E * s), F.lit(E / 2))
    rho = F.lit(AF) * F.pow(t, F.lit(N))
    theta = F.lit(N) * F.radians(lon - F.lit(LON0))
    x = (F.lit(FALSE_EASTING_M) + rho * F.sin(theta)) * FT_PER_M
    y = (F.lit(FALSE_NORTHING_M) + F.lit(RHO0) - rho * F.cos(theta)) * FT_PER_M
    return x, y


def to_lon_lat(x_ft: Column, y_ft: Column, iterations: int = 6):
    """Inverse projection: (lon, lat) Columns in degrees (fixed-point iteration for lat)."""
    dx = x_ft / FT_PER_M - F.lit(FALSE_EASTING_M)
    dy = F.lit(RHO0) - (y_ft / FT_PER_M - F.lit(FALSE_NORTHING_M))
    rho = F.sqrt(dx * dx + dy * dy) * (1 if N > 0 else -1)
    theta = F.atan2(dx, dy)
    t = F.pow(rho / F.lit(AF), F.lit(1 / N))
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(iterations):
        s = F.sin(phi)
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - E * s) / (1 + E * s), F.lit(E / 2)))
    return F.degrees(theta / F.lit(N)) + F.lit(LON0), F.degrees(phi)


def sql_to_state_plane(lon: str, lat: str) -> tuple[str, str]:
    phi = f"radians({lat})"
    t = f"(tan({math.pi / 4!r} - {phi} / 2) / pow((1 - {E!r} * sin({phi})) / (1 + {E!r} * sin({phi})), {E / 2!r}))"
    rho = f"({AF!r} * pow({t}, {N!r}))"
    theta = f"({N!r} * radians({lon} - ({LON0!r})))"
    x = f"(({FALSE_EASTING_M!r} + {rho} * sin({theta})) * {FT_PER_M!r})"
    y = f"(({FALSE_NORTHING_M!r} + {RHO0!r} - {rho} * cos({theta})) * {FT_PER_M!r})"
    return x, y
