"""Date/time column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# Spanish month names used by the report (1..12).
MESES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre",
         "octubre", "noviembre", "diciembre"]


def parse_ymd_hms(c) -> Column:  # D1: bad text -> NULL
    return F.try_to_timestamp(col_(c), F.lit("yyyy-MM-dd HH:mm:ss"))


def first_of_month(year, month) -> Column:  # D2 (midnight, not 12:00 GMT)
    return F.make_timestamp_ntz(col_(year), col_(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def floor_month(c) -> Column:  # D3
    return F.date_trunc("month", col_(c))


def parts(c) -> dict[str, Column]:  # D4
    c = col_(c)
    return {"dia": F.dayofmonth(c), "mes": F.month(c), "ano": F.year(c), "hora": F.hour(c)}


def month_name(c, spanish: bool = False) -> Column:  # D5
    if spanish:
        names = F.array(*[F.lit(m) for m in MESES])
        return F.element_at(names, F.month(col_(c)))
    return F.date_format(col_(c), "MMMM")


def hours_to_minutes(c) -> Column:  # D6
    return col_(c) * 60


def monthly_to_hourly(c) -> Column:  # D6: 30 days x 24 h
    return col_(c) / 720


def seconds_between(a, b) -> Column:  # D7
    return F.timestamp_diff("SECOND", col_(a), col_(b))


def add_seconds(ts, secs) -> Column:
    return F.timestamp_add("SECOND", col_(secs), col_(ts))
