"""Dates and times of log records and of the daily schedule."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_date(text: Column) -> Column:
    """The record date; months and days may lack a leading zero. Null if it is no calendar date."""
    shaped = F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\\z"), text)
    return F.try_to_date(shaped, "yyyy-M-d")


def date_path(day: Column) -> Column:
    """``yyyy/mm/dd/`` with leading zeros."""
    return F.date_format(day, "yyyy/MM/dd/")


def target_day(time_text: Column) -> Column:
    """The day before an ISO time, on the calendar of the time's own offset."""
    return F.date_sub(F.to_date(F.substring(time_text, 1, 10), "yyyy-MM-dd"), 1)


def target_day_of(time_text: str) -> datetime.date:
    """:func:`target_day` for the single argument of the daily job."""
    moment = datetime.datetime.fromisoformat(time_text)
    return moment.date() - datetime.timedelta(days=1)
