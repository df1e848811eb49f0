"""Calendar functions (F3, F4, F5, F7, F19) as pure date arithmetic.

Week starts are computed as ``date - weekday(date)``: no time zone enters,
so the result is the same on any session zone.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(d: Column) -> Column:
    """F4 (from a date): Monday of the ISO week."""
    d = d.cast("date")
    return F.date_sub(d, F.weekday(d))


def iso_year(d: Column) -> Column:
    """ISO week-numbering year."""
    return F.extract(F.lit("YEAROFWEEK"), d.cast("date")).cast("int")


def iso_week(d: Column) -> Column:
    return F.weekofyear(d.cast("date"))


def week_start_from_parts(year: Column, week: Column) -> Column:
    """F4 (from parts): Monday of ISO week `week` of ISO year `year`."""
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(week_start(jan4), (week - 1) * 7)


def iso_week_label(year: Column, week: Column) -> Column:
    """'YYYY-Www-1' with a zero-padded week."""
    return F.format_string("%d-W%02d-1", year, week)


def day_name(d: Column) -> Column:
    return F.date_format(d.cast("date"), "EEEE")


def minus_weeks(d: Column, weeks: int) -> Column:
    """date - n weeks."""
    return F.date_sub(d.cast("date"), 7 * weeks)
