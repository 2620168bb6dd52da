"""Date expressions of release calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(d: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(d, "MM")


def month_after(d: Column, n: int | Column) -> Column:
    """First day of the month ``n`` months on."""
    return F.trunc(F.add_months(d, n), "MM")


def months_between(later: Column, earlier: Column) -> Column:
    """Calendar months, whatever the days."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("int")


def first_friday_release(ref: Column) -> Column:
    """The first Friday of the next month; a week later when that is New Year's Day or the 4th of July."""
    friday = F.next_day(F.date_sub(month_after(ref, 1), 1), "FR")
    holiday = ((F.month(friday) == 1) & (F.day(friday) == 1)) | ((F.month(friday) == 7) & (F.day(friday) == 4))
    return F.when(holiday, F.date_add(friday, 7)).otherwise(friday)


def quarterly_release(quarter_end: Column, modern_from: Column) -> Column:
    """First day of the month 5 months after quarters 1 to 3 and 6 after quarter 4; 7 before ``modern_from``."""
    lag = F.when(quarter_end < modern_from, 7).when(F.quarter(quarter_end) == 4, 6).otherwise(5)
    return month_after(quarter_end, lag)


def period_date(year: Column, period: Column) -> Column:
    """The date of a period code: M01-M12, Q01-Q04, S01-S02, A01; others, M13 among them, are null."""
    number = F.substring(period, 2, 2).try_cast("int")
    kind = F.substring(period, 1, 1)
    at = (
        F.when((kind == "M") & number.between(1, 12), number)
        .when((kind == "Q") & number.between(1, 4), number * 3 - 2)
        .when((kind == "S") & number.between(1, 2), number * 6 - 5)
        .when(kind == "A", F.lit(1))
    )
    return F.make_date(year, at, F.lit(1))


def era(date: Column, breaks: list[str]) -> Column:
    """The number of ``breaks`` (ascending dates) that a date has reached."""
    out = F.lit(0)
    for n, start in enumerate(breaks, 1):
        out = F.when(date >= F.lit(start).cast("date"), F.lit(n)).otherwise(out)
    return out
