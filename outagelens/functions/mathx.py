"""Math column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# Fixed value: Earth radius in km used by the great-circle join (WGS-84 equator).
EARTH_RADIUS_KM = 6378.137


def log_shift(c, shift: float = 1.0) -> Column:  # M1
    return F.log1p(col_(c)) if shift == 1.0 else F.log(col_(c) + shift)


def log10_pos(c) -> Column:  # M2: x > 0 only
    return F.when(col_(c) > 0, F.log10(col_(c)))


def round_half_even(c, digits: int = 2) -> Column:  # M3 (R round)
    return F.bround(col_(c), digits)


def haversine_km(lat1, lon1, lat2, lon2, radius_km: float = EARTH_RADIUS_KM) -> Column:  # M5
    p1, p2 = F.radians(col_(lat1)), F.radians(col_(lat2))
    dp = p2 - p1
    dl = F.radians(col_(lon2)) - F.radians(col_(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * radius_km) * F.asin(F.sqrt(a))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius_km: float = EARTH_RADIUS_KM) -> str:
    """Same formula as SQL text (used by oracles)."""
    return (f"{2 * radius_km} * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * "
            f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))")


def rnd(c, digits: int = 6) -> Column:
    """Round half-up on the binary value: floor(x*10^d + 0.5) / 10^d.

    Gives the same double in Spark and DuckDB (``round`` differs on ties:
    Spark rounds the decimal text, DuckDB the binary value)."""
    scale = float(10 ** digits)
    return (F.floor(col_(c) * scale + 0.5) / scale).cast("double")


def rnd_sql(expr: str, digits: int = 6) -> str:
    scale = float(10 ** digits)
    return f"CAST(floor(({expr}) * {scale} + 0.5) / {scale} AS DOUBLE)"
