"""Number, date and distance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
GRID_DEGREES = 0.05
# Java reads "1d", "1f" and hexadecimal floats as numbers; the register's readers do not.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def decimal_comma(c: Column) -> Column:
    """Double from a text with decimal comma or point; anything else is NULL."""
    s = F.replace(c.cast("string"), F.lit(","), F.lit("."))
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def small_int(c: Column) -> Column:
    """Integer from a trimmed code, NULL when it is none."""
    return F.trim(c).try_cast("int")


def register_date(c: Column) -> Column:
    """Timestamp from `YYYYMMDD`; blanks, zeros and impossible dates are NULL."""
    text = F.trim(c)
    # most columns hold little else than these, and a failed parse costs much more than a good one
    return F.when(~text.isin("", "0", "00000000"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, rounded half to even; 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / whole * 100, digits))


def share(part: Column, whole: Column) -> Column:
    """Unrounded share in percent; 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * 100)


def grid_cell(degrees: Column, step: float = GRID_DEGREES) -> Column:
    """Index of the nearest grid line (half to even)."""
    return F.bround(degrees / F.lit(step)).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; NULL when a coordinate is missing."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))))
