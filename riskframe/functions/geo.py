"""Geographic column functions.

Both replace per-row Python UDFs of the reference with native arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in metres (IUGG), used by the haversine distance.
EARTH_RADIUS_M = 6371008.8


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dms_to_decimal(c: Column | str) -> Column:
    """``DDMMSSH`` text (e.g. ``413515N``) -> signed decimal degrees.

    Degrees are the first two characters, minutes the next two, seconds the
    next two; ``W`` and ``S`` give a negative sign.  Malformed text -> null.
    """
    s = F.trim(_c(c).cast("string"))
    deg = F.substring(s, 1, 2).try_cast("double")
    minutes = F.substring(s, 3, 2).try_cast("double")
    sec = F.substring(s, 5, 2).try_cast("double")
    hemi = F.upper(F.substring(s, -1, 1))
    sign = F.when(hemi.isin("W", "S"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (deg + minutes / 60.0 + sec / 3600.0) * sign


def haversine_m(lat1: Column | str, lon1: Column | str,
                lat2: Column | str, lon2: Column | str) -> Column:
    """C14: great-circle distance in metres on a sphere of radius 6371008.8 m."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlmb = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The same distance as SQL text (used by the oracle queries)."""
    return (f"2 * {EARTH_RADIUS_M} * asin(least(1.0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
            f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))")
