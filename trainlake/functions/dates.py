"""Date expressions. Every "today" is an argument, never the clock."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# A calendar date, optionally followed by a time of day and an offset.
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"

# A time of day followed by an offset or the name of a zone.
WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ][0-9:.]*[^0-9:.]"


def day_literal(day: date | str) -> Column:
    return F.lit(str(day)).cast("date")


def time_literal(moment: datetime | str) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def parse_iso(text: Column) -> Column:
    """ISO text to a UTC time, in any session time zone; text without an offset is UTC, anything else is NULL."""
    micros = F.unix_micros(text.try_cast("timestamp"))
    shifted = time_literal("1970-01-01 00:00:00") + F.make_dt_interval(secs=(micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    moment = F.when(text.rlike(WITH_OFFSET), shifted).otherwise(text.try_cast("timestamp_ntz"))
    return F.when(text.rlike(ISO_SHAPE), moment)


def utc_time(moment: Column) -> Column:
    """A moment (with a zone) as the UTC time on the clock, in any session time zone."""
    micros = F.unix_micros(moment.cast("timestamp"))
    return time_literal("1970-01-01 00:00:00") + F.make_dt_interval(secs=(micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def week_start(day: Column) -> Column:
    return F.trunc(day.cast("date"), "week")


def next_week_dates(day: Column) -> Column:
    """The seven dates of the week after the one ``day`` lies in."""
    monday = F.date_add(week_start(day), 7)
    return F.sequence(monday, F.date_add(monday, 6))


def days_left(day: Column, competition: date | str) -> Column:
    return F.greatest(F.datediff(day_literal(competition), day.cast("date")), F.lit(0))


def training_day(day: Column, start: date | str) -> Column:
    return F.datediff(day.cast("date"), day_literal(start))


def training_week(day: Column, start: date | str) -> Column:
    return (F.floor(training_day(day, start) / 7) + 1).cast("int")


def age_days(created_at: Column, as_of: Column) -> Column:
    """Age as a fraction of days, from microseconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(as_of) - micros(created_at)).cast("double") / F.lit(86_400_000_000.0)
