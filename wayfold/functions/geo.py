"""Distances, bearings, cells and units as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.schemas import EARTH_M

Num = Column | float | int


def _c(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def distance(lat1: Num, lng1: Num, lat2: Num, lng2: Num) -> Column:
    """Metres between two places on the sphere (haversine)."""
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    s = F.sin((a2 - a1) / 2) * F.sin((a2 - a1) / 2)
    d = F.sin((F.radians(_c(lng2)) - F.radians(_c(lng1))) / 2)
    h = F.sqrt(s + F.cos(a1) * F.cos(a2) * d * d)
    return 2 * EARTH_M * F.asin(F.when(h > 1, 1.0).otherwise(h))  # not least(), which skips nulls


def exact_radians(degrees: float) -> float:
    return degrees * (math.pi / 180)


def exact_distance(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """distance() of plain numbers with C's functions, whose last digits differ from Java's."""
    a1, a2 = exact_radians(lat1), exact_radians(lat2)
    h = math.sqrt(math.pow(math.sin((a2 - a1) / 2), 2) + math.cos(a1) * math.cos(a2) * math.pow(math.sin((exact_radians(lng2) - exact_radians(lng1)) / 2), 2))
    return 2 * EARTH_M * math.asin(1.0 if h > 1 else h)


def within(metres: Num, radius: Num) -> Column:
    """Whether a distance is no more than a radius. A place that makes the radius lies on its border, where last digits, which
    differ by the order of sums, don't count: a micrometre is less than any distance between two fixes."""
    return _c(metres) <= _c(radius) + 1e-6


def positive_degrees(x: Column) -> Column:
    return F.when(x < 0, x + 360).otherwise(x)


def bearing(lat1: Num, lng1: Num, lat2: Num, lng2: Num) -> Column:
    """Initial bearing in degrees from 0 to 360; null between equal places."""
    a1, a2, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lng2) - _c(lng1))
    x = F.degrees(F.atan2(F.sin(d) * F.cos(a2), F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(d)))
    return F.when(~((_c(lat1) == _c(lat2)) & (_c(lng1) == _c(lng2))), positive_degrees(x))


def xyz(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lng)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def lat_of(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def lng_of(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def clamp(x: Num, low: Num, high: Num) -> Column:
    return F.when(_c(x).isNotNull(), F.greatest(_c(low), F.least(_c(high), _c(x))))


def usable(lat: Column, lng: Column, h_acc: Column) -> Column:
    """A coordinate that may be used: valid, not (0, 0), and of an accuracy that isn't negative."""
    ok = (h_acc >= 0) & lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0))
    return F.coalesce(ok, F.lit(False))


def round_half_away(x: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def truncated(x: Column) -> Column:
    """Towards zero, as a whole number: what a cast does."""
    return x.cast("long")


CELL_DEGREES = {1: 10.0, 2: 0.1}


def cell_min(x: Column, depth: int, low: float) -> Column:
    """The lower side of a coordinate's cell at a depth (1: ten degrees, 2: a tenth); ``low`` is -90 or -180."""
    if depth == 0:
        return F.lit(low)
    size = CELL_DEGREES[depth]
    return low + truncated((x - low) / size) * size
