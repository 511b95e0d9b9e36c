"""Day-of-year arithmetic as Spark column expressions.

Days of year are 1..366. Southern sites are shifted half a year so that all
sites share one seasonal clock.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HARMONICS = ("cos1", "sin1", "cos2", "sin2")


def day_of_year(date: Column) -> Column:
    return F.dayofyear(date)


def year_text(date: Column) -> Column:
    """Four-digit year as text (years are factor levels in the models)."""
    return F.date_format(date, "yyyy")


def shift_half_year(day: Column) -> Column:
    """Move a day back 183 days on a 365-day circle: 183 -> 365, 184 -> 1."""
    return F.when(day <= 183, day + 182).otherwise(day - 183)


def seasonal_day(day: Column, latitude: Column) -> Column:
    """The shifted day south of the equator, the day itself elsewhere."""
    return F.when(latitude < 0, shift_half_year(day)).when(latitude >= 0, day)


def wrap_day(day: Column) -> Column:
    """Fold days just outside 1..365 back onto the circle."""
    return F.when(day < 1, day + 365).when(day > 365, day - 365).otherwise(day)


def cap_day(day: Column, last: int = 365) -> Column:
    return F.when(day > last, F.lit(last)).otherwise(day)


def whole_day(day: Column) -> Column:
    """Round half to even, and call day 0 day 1 (medians can end in .5)."""
    rounded = F.bround(day)
    return F.when(rounded == 0, F.lit(1.0)).otherwise(rounded)


def harmonics(day: Column, period: int = 365) -> dict[str, Column]:
    """First and second harmonic of the seasonal clock, by column name."""
    angle = F.lit(2 * math.pi) * day / F.lit(float(period))
    return {
        "cos1": F.cos(angle),
        "sin1": F.sin(angle),
        "cos2": F.cos(angle * 2),
        "sin2": F.sin(angle * 2),
    }


def date_span(start: Column, end: Column, closed: str = "left") -> Column:
    """Dates of an interval as an array.

    ``left`` gives [start, end - 1], ``both`` gives [start, end]. Sequences run
    downwards when the end lies before the start, so an interval with
    end = start and ``left`` has two dates (start, start - 1).
    """
    if closed == "left":
        return F.sequence(start, F.date_sub(end, 1))
    if closed == "both":
        return F.sequence(start, end)
    raise ValueError(f"closed must be 'left' or 'both', not {closed!r}")


def day_number_span(start: Column, end: Column, wrap: bool = False) -> Column:
    """Days of year in (start, end] as an array of int.

    Without ``wrap`` an interval over New Year counts *down* from the start
    day to the end day; ``wrap=True`` lists the days really covered.
    """
    if wrap:
        dates = F.sequence(F.date_add(start, 1), end)
        days = F.transform(dates, lambda d: F.dayofyear(d))
        return F.when(end > start, days).otherwise(F.array().cast("array<int>"))
    return F.sequence(F.dayofyear(start) + 1, F.dayofyear(end))
