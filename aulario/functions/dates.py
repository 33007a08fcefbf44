"""Slot instants, calendar weeks and date texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from aulario.functions.numbers import int_div


def now(as_of: dt.datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp")


def today(as_of: dt.datetime) -> Column:
    return F.lit(as_of.date())


def at_minute(fecha: Column | str, minute: Column | str) -> Column:
    """The instant ``minute`` minutes into the day ``fecha``."""
    fecha = F.col(fecha) if isinstance(fecha, str) else fecha
    minute = F.col(minute) if isinstance(minute, str) else minute
    return fecha.cast("timestamp") + F.make_dt_interval(mins=minute)


def plus_minutes(instant: Column, minutes: int) -> Column:
    return instant + F.make_dt_interval(mins=F.lit(minutes))


def clock(minute: Column | str) -> Column:
    """Minute of the day as HH:MM."""
    minute = F.col(minute) if isinstance(minute, str) else minute
    return F.format_string("%02d:%02d", int_div(minute, F.lit(60)), minute % 60)


def dmy(fecha: Column | str) -> Column:
    return F.date_format(fecha, "dd/MM/yyyy")


def dmy_clock(instant: Column | str) -> Column:
    return F.date_format(instant, "dd/MM/yyyy HH:mm")


def iso_date(text: Column | str) -> Column:
    """Strict YYYY-MM-DD; anything else is NULL."""
    text = F.col(text) if isinstance(text, str) else text
    shaped = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text)
    return F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd")).cast("date")


def sunday_week(fecha: Column | str) -> Column:
    """Week of the year 0-53, weeks starting on Sunday; days before the first Sunday are week 0."""
    return int_div(F.dayofyear(fecha) + 7 - F.dayofweek(fecha), F.lit(7)).cast("int")


def monday_of(fecha: Column | str) -> Column:
    return F.date_trunc("week", fecha).cast("date")


def week_bounds(as_of: dt.datetime) -> tuple[dt.date, dt.date]:
    """Monday and Sunday of the week that holds ``as_of``."""
    monday = as_of.date() - dt.timedelta(days=as_of.weekday())
    return monday, monday + dt.timedelta(days=6)
