"""Closed forms for the two cylindrical projections in use, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.nulls import as_col

# WGS84 semi-major axis (m), flattening, standard parallel of the equal-area grid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
STANDARD_PARALLEL_DEG = 30.0

_E2 = WGS84_F * (2 - WGS84_F)
_E = math.sqrt(_E2)
_PHI_S = math.radians(STANDARD_PARALLEL_DEG)
_K0 = math.cos(_PHI_S) / math.sqrt(1 - _E2 * math.sin(_PHI_S) ** 2)


def web_x(lon: Column | str) -> Column:
    return F.radians(as_col(lon)) * WGS84_A


def web_y(lat: Column | str) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(as_col(lat)) / 2)) * WGS84_A


def lon_from_web(x: Column | str) -> Column:
    return F.degrees(as_col(x) / WGS84_A)


def lat_from_web(y: Column | str) -> Column:
    return F.degrees(2 * F.atan(F.exp(as_col(y) / WGS84_A)) - F.lit(math.pi / 2))


def equal_area_x(lon: Column | str) -> Column:
    return F.radians(as_col(lon)) * (WGS84_A * _K0)


def equal_area_y(lat: Column | str) -> Column:
    """a * q(lat) / (2 k0), q the authalic function of the ellipsoid."""
    s = F.sin(F.radians(as_col(lat)))
    es = s * _E
    q = (s / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * _E)) * (1 - _E2)
    return q * (WGS84_A / (2 * _K0))
