"""Time buckets, date parts and their labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIXED_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
MONTHS = {"month": 1, "quarter": 3, "year": 12}
GRAINS = (*FIXED_SECONDS, "week", *MONTHS)
PARTS = ("quarter", "month", "week", "dom", "dow", "hour", "minute", "second")
#: Labels of months and weekdays (Monday first); fixed values.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _floor_div(x: Column, n: int) -> Column:
    return F.floor(x / F.lit(n)).cast("long")


def month_index(ts: Column, fiscal_start: int = 1) -> Column:
    """Months since year 0, counted from the fiscal year's first month."""
    return F.year(ts) * 12 + F.month(ts) - 1 - (fiscal_start - 1)


def month_start(index: Column, fiscal_start: int = 1) -> Column:
    whole = index + (fiscal_start - 1)
    return F.make_date(_floor_div(whole, 12).cast("int"), (F.pmod(whole, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")


def bucket(ts: Column, grain: str, every: int = 1, week_start: int = 1, fiscal_start: int = 1, zone: str | None = None) -> Column:
    """The start of the ``every`` x ``grain`` bucket that holds ``ts``, without zone.

    Fixed grains are counted from 1970; weeks from the first week start of 1970
    or later (1 Monday .. 7 Sunday); months, quarters and years by month number
    from the fiscal year's start.  ``zone``: read ``ts`` as UTC and take that
    zone's wall clock.
    """
    if zone:
        ts = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))
    ts = ts.cast("timestamp_ntz")
    if grain in FIXED_SECONDS:
        if every == 1:
            return F.date_trunc(grain, ts).cast("timestamp_ntz")
        # Epoch arithmetic between two timestamps without zone, so that the session's zone plays no part.
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        width = FIXED_SECONDS[grain] * every
        seconds = F.timestamp_diff("SECOND", epoch, F.date_trunc("second", ts).cast("timestamp_ntz"))
        return F.timestamp_add("SECOND", _floor_div(seconds, width) * width, epoch)
    if grain == "week":
        first = F.lit(f"1970-01-{[5, 6, 7, 1, 2, 3, 4][week_start - 1]:02d}").cast("date")
        days = F.datediff(ts.cast("date"), first)
        return F.date_add(first, (_floor_div(days, 7 * every) * 7 * every).cast("int")).cast("timestamp_ntz")
    step = MONTHS[grain] * every
    return month_start(_floor_div(month_index(ts, fiscal_start), step) * step, fiscal_start)


def bucket_label(start: Column, grain: str, fiscal_start: int = 1) -> Column:
    """``2024-03``, ``2024 Q1``, ``FY2023 Q4``, ``2024-03-05 14:00``."""
    if grain in ("day", "week"):
        return F.date_format(start, "yyyy-MM-dd")
    if grain in ("hour", "minute"):
        return F.date_format(start, "yyyy-MM-dd HH:mm")
    if grain == "second":
        return F.date_format(start, "yyyy-MM-dd HH:mm:ss")
    if grain == "month":
        return F.date_format(start, "yyyy-MM")
    index = month_index(start, fiscal_start)
    year = _floor_div(index, 12).cast("string")
    if fiscal_start != 1:
        year = F.concat(F.lit("FY"), year)
    if grain == "year":
        return year
    quarter = (_floor_div(F.pmod(index, F.lit(12)), 3) + 1).cast("string")
    return F.concat(year, F.lit(" Q"), quarter)


def _named(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def date_part(ts: Column, part: str) -> tuple[Column, Column]:
    """(label, rank) of a part of a date."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    if part == "quarter":
        return F.concat(F.lit("Q"), F.quarter(ts).cast("string")), F.quarter(ts)
    if part == "month":
        return _named(MONTH_NAMES, F.month(ts) - 1), F.month(ts)
    if part == "week":
        return F.concat(F.lit("W"), two(F.weekofyear(ts))), F.weekofyear(ts)
    if part == "dom":
        return two(F.dayofmonth(ts)), F.dayofmonth(ts)
    if part == "dow":
        return _named(DAY_NAMES, F.weekday(ts)), F.weekday(ts)
    field = {"hour": F.hour, "minute": F.minute, "second": F.second}[part](ts)
    return two(field), field


def period_number(ts: Column, grain: str) -> Column:
    """A running number of the period that holds ``ts``; differences count periods."""
    if grain in MONTHS:
        return _floor_div(month_index(ts), MONTHS[grain])
    epoch = F.lit("1970-01-05").cast("date")
    if grain == "week":
        return _floor_div(F.datediff(ts.cast("date"), epoch), 7)
    if grain == "day":
        return F.datediff(ts.cast("date"), epoch).cast("long")
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return _floor_div(F.timestamp_diff("SECOND", origin, ts.cast("timestamp_ntz")), FIXED_SECONDS[grain])
