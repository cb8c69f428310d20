"""Date, time and interval functions that Spark lacks or spells differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")


def epoch_seconds(ts: Column) -> Column:
    """Seconds from 1970 with a fraction, of a time with or without zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def time_slice(ts: Column, seconds: int, end: bool = False) -> Column:
    """Start (or end) of the slice of so many seconds from 1970 that holds ts."""
    at = (F.floor(epoch_seconds(ts) / seconds) + (1 if end else 0)) * seconds
    return F.timestamp_seconds(at).cast("timestamp_ntz")


def date_bin(ts: Column, seconds: int, origin: str = "1970-01-01 00:00:00") -> Column:
    o = epoch_seconds(F.lit(origin).cast("timestamp_ntz"))
    return F.timestamp_seconds(F.floor((epoch_seconds(ts) - o) / seconds) * seconds + o).cast("timestamp_ntz")


def week_start(d: Column, first: str = "MONDAY") -> Column:
    """First day of the week of a date, for weeks that begin on the given day."""
    shift = DAYS.index(first.upper())
    return F.date_add(F.trunc(F.date_sub(d.cast("date"), shift), "week"), shift)


def week_of_year(d: Column, first: str = "SUNDAY") -> Column:
    """Week number from 0: weeks begin on the given day, days before the first such day are week 0."""
    new_year = F.trunc(d, "year")
    before = F.datediff(new_year, week_start(new_year, first))  # days of the year's first week that lie in the last year
    return F.floor((F.dayofyear(d) - 1 + before) / 7 + F.when(before == 0, 1).otherwise(0)).cast("int")


def previous_day(d: Column, day: str) -> Column:
    """The last such weekday before a date."""
    return F.next_day(F.date_sub(d.cast("date"), 8), day)


def to_days(d: Column) -> Column:
    """Days from year 0."""
    return F.datediff(d.cast("date"), F.lit("1970-01-01").cast("date")) + 719528


def months_between_whole(later: Column, earlier: Column) -> Column:
    """Whole months from earlier to later, toward zero."""
    m = F.months_between(later, earlier)
    return F.when(m < 0, F.ceil(m)).otherwise(F.floor(m)).cast("int")


def date_diff_boundaries(unit: str, start: Column, end: Column) -> Column:
    """Number of unit boundaries between two times."""
    months = lambda t: F.year(t) * 12 + F.month(t)
    return {
        "year": lambda: F.year(end) - F.year(start),
        "quarter": lambda: F.year(end) * 4 + F.quarter(end) - F.year(start) * 4 - F.quarter(start),
        "month": lambda: months(end) - months(start),
        "week": lambda: (F.datediff(F.trunc(end, "week"), F.trunc(start, "week")) / 7).cast("int"),
        "day": lambda: F.datediff(end, start),
        "hour": lambda: F.floor(epoch_seconds(end) / 3600) - F.floor(epoch_seconds(start) / 3600),
    }[unit]()


def at_time_zone(ts: Column, zone: str, has_zone: bool = False) -> Column:
    """ts AT TIME ZONE zone: of a time without zone the instant when clocks there show it, of an instant what clocks there show."""
    here = F.current_timezone()
    if has_zone:
        return F.convert_timezone(here, F.lit(zone), ts.cast("timestamp_ntz"))
    return F.convert_timezone(F.lit(zone), here, ts.cast("timestamp_ntz")).cast("timestamp")


def between_zones(ts: Column, source: str, target: str) -> Column:
    """What clocks in target show when those in source show ts."""
    return F.convert_timezone(F.lit(source), F.lit(target), ts.cast("timestamp_ntz"))


def justify_hours(days: Column, seconds: Column) -> tuple[Column, Column]:
    """Whole days of the seconds moved to the days."""
    more = F.when(seconds < 0, F.ceil(seconds / 86400)).otherwise(F.floor(seconds / 86400))
    return days + more, seconds - more * 86400


def justify_days(months: Column, days: Column) -> tuple[Column, Column]:
    """Every 30 days become a month."""
    more = F.when(days < 0, F.ceil(days / 30)).otherwise(F.floor(days / 30))
    return months + more, days - more * 30


def last_day_of(unit: str, d: Column) -> Column:
    start = F.trunc(d, unit)
    step = {"year": F.expr("INTERVAL 1 YEAR"), "quarter": F.expr("INTERVAL 3 MONTH"), "month": F.expr("INTERVAL 1 MONTH"), "week": F.expr("INTERVAL 7 DAY")}[unit]
    return F.date_sub((start + step).cast("date"), 1)


def is_business_day(d: Column) -> Column:
    return F.weekday(d) < 5
