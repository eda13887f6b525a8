"""Dates of reports, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def academic_year(d: Column) -> Column:
    """The year in which the academic year, from 1 July, began."""
    return F.year(F.add_months(F.to_date(d), -6))


def academic_label(d: Column) -> Column:
    """2026-27"""
    y = academic_year(d)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def quarter_start(d: Column) -> Column:
    return F.to_date(F.date_trunc("quarter", d))


def half_open(d: Column, start: Column, end: Column) -> Column:
    return (d >= start) & (d < end)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact to the microsecond."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1_000_000)


def days_until(due: Column, today: Column) -> Column:
    return F.datediff(due, today)


def on_time(submitted: Column, due: Column) -> Column:
    return F.to_date(submitted) <= F.to_date(due)
