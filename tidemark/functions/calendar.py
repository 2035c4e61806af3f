"""Calendar expressions: water years, seasons and how many days a period should have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seasons and their months, in order; the water year's first month; the baseline years.
SEASONS = {"winter": (1, 2), "pre-monsoon": (3, 4, 5), "monsoon": (6, 7, 8, 9), "post-monsoon": (10, 11, 12)}
WATER_YEAR_START = 6


def water_year(date: Column) -> Column:
    """The year in which the June-to-May year of ``date`` began."""
    return (F.year(date) - (F.month(date) < WATER_YEAR_START).cast("int")).cast("int")


def water_year_label(year: Column) -> Column:
    """2024 -> 2024-25, and 1999 -> 1999-00."""
    return F.format_string("%d-%02d", year, F.pmod(year + 1, F.lit(100)))


def season(date: Column) -> Column:
    """The season's name; none crosses a calendar year."""
    out = None
    for name, months in SEASONS.items():
        hit = F.month(date).isin(*months)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def season_order(name: Column) -> Column:
    """1 to 4."""
    return F.array_position(F.array(*map(F.lit, SEASONS)), name).cast("int")


def days_in_year(year: Column, water: bool = False) -> Column:
    """Days of the calendar or water year that starts in ``year``."""
    start = F.make_date(year, F.lit(WATER_YEAR_START if water else 1), F.lit(1))
    return F.datediff(F.add_months(start, 12), start)


def days_in_season(year: Column, name: Column) -> Column:
    """Days of a season, leap years included."""
    spans = [(months[0], months[-1]) for months in SEASONS.values()]
    out = None
    for (first, last), key in zip(spans, SEASONS):
        start = F.make_date(year, F.lit(first), F.lit(1))
        n = F.datediff(F.add_months(start, last - first + 1), start)
        out = F.when(name == key, n) if out is None else out.when(name == key, n)
    return out
