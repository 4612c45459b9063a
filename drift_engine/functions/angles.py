"""Angles and numbers as column expressions. Bearings are in degrees clockwise from north; NULL stands for missing, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c) -> Column:
    """A double with NaN and infinities as NULL; text that is no number too."""
    d = F.col(c) if isinstance(c, str) else c
    d = d.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def wrap360(a: Column) -> Column:
    """Into [0, 360); what rounds to 360 is 0."""
    w = F.pmod(a, F.lit(360.0))
    return F.when(360.0 - w <= 1e-12, F.lit(0.0)).otherwise(w)


def difference(a: Column, b: Column) -> Column:
    """a - b as a signed angle in [-180, 180)."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def apart(a: Column, b: Column) -> Column:
    """The angle between two bearings, 0 to 180."""
    return F.abs(difference(a, b))


def axial_mismatch(direction: Column, bearing: Column) -> Column:
    """The angle between a direction and an axis, 0 to 90."""
    return F.least(apart(direction, bearing), apart(direction, bearing + 180.0))


def bearing_of(x: Column, y: Column, least: float = 0.0) -> Column:
    """Bearing of a vector (east, north), NULL unless it is longer than `least`."""
    return F.when(F.hypot(x, y) > least, wrap360(F.degrees(F.atan2(x, y))))


def ulp(value: Column) -> Column:
    """Spacing of doubles at |value|."""
    v = F.abs(value)
    return F.when(v > 0, F.pow(F.lit(2.0), F.floor(F.log2(v)) - 52.0)).otherwise(F.lit(5e-324))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def mean_bearing(a: Column) -> Column:
    """Aggregate: the direction of the mean unit vector of angles, -180 to 180."""
    r = F.radians(a)
    return F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))))


def longitude_span(a: Column) -> Column:
    """Aggregate: degrees of the shortest arc that holds all longitudes, 360 less the largest gap between neighbours.

    Distinct longitudes are collected, of which a grid has no more than columns.
    """
    ordered = F.sort_array(F.collect_set(F.pmod(a, F.lit(360.0))))
    following = F.concat(F.slice(ordered, 2, F.size(ordered)), F.array(F.element_at(ordered, 1) + 360.0))
    gaps = F.zip_with(ordered, following, lambda x, y: y - x)
    return F.when(F.size(ordered) <= 1, F.lit(0.0)).otherwise(360.0 - F.array_max(gaps))
