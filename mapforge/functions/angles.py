"""Angles in degrees on the circle and the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def angle_lonlat(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in degrees."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    c = F.cos(a) * F.cos(b) * F.cos(d) + F.sin(a) * F.sin(b)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def modulo360(x: Column) -> Column:
    return x - 360.0 * F.floor(x / 360.0)


def mean_degrees(x: Column) -> Column:
    """Mean of angles: if some lie in [0, 180) and some in [180, 360), those from 180 on count less 360. In [0, 360); NaN is skipped."""
    v = F.when(~F.isnan(x), modulo360(x))
    both = (F.min(v) < 180) & (F.max(v) >= 180)
    plain, wrapped = F.avg(v), F.avg(F.when(v >= 180, v - 360.0).otherwise(v))
    return modulo360(F.when(both, wrapped).otherwise(plain))


def minmax_degrees(x: Column) -> tuple[Column, Column]:
    """Smallest and largest angle around the mean: each counts from 180 degrees below the mean."""
    v = F.when(~F.isnan(x), modulo360(x))
    both = (F.min(v) < 180) & (F.max(v) >= 180)
    w = F.when(v >= 180, v - 360.0).otherwise(v)
    return modulo360(F.when(both, F.min(w)).otherwise(F.min(v))), modulo360(F.when(both, F.max(w)).otherwise(F.max(v)))


def barycenter_lonlat(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Direction of the mean unit vector of positions, in degrees; positions with a NaN are skipped."""
    ok = ~(F.isnan(lon) | F.isnan(lat))
    x = F.sum(F.when(ok, F.cos(F.radians(lat)) * F.cos(F.radians(lon))))
    y = F.sum(F.when(ok, F.cos(F.radians(lat)) * F.sin(F.radians(lon))))
    z = F.sum(F.when(ok, F.sin(F.radians(lat))))
    return modulo360(F.degrees(F.atan2(y, x))), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
