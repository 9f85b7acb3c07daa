"""Period arithmetic: ``"<week> | <year>"`` strings and ``year*100+week`` integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_key(year: Column, week: Column) -> Column:
    """Sortable period number."""
    return year.cast("bigint") * 100 + week.cast("bigint")


def period_of(label: Column) -> Column:
    """Sortable period number of a ``"<week> | <year>"`` label."""
    return period_key(year_of(label), week_of(label))


def week_of(label: Column) -> Column:
    return F.split_part(label, F.lit(" | "), F.lit(1)).try_cast("int")


def year_of(label: Column) -> Column:
    return F.split_part(label, F.lit(" | "), F.lit(2)).try_cast("int")


def period_label(year: Column, week: Column) -> Column:
    return F.concat_ws(" | ", week.cast("string"), year.cast("string"))


def next_label(label: Column, new_year: Column) -> Column:
    """Following period; the first of the next year where ``new_year`` holds."""
    year, week = year_of(label), week_of(label)
    return F.when(new_year, period_label(year + 1, F.lit(1))).otherwise(period_label(year, week + 1))


def file_safe(label: Column) -> Column:
    return F.replace(label, F.lit(" | "), F.lit("-"))


def market_period(code: Column) -> Column:
    """Period label of a market code such as ``23WK05`` (two-digit year, two-digit week)."""
    year = F.regexp_extract(code, r"^(\d{2})[A-Z]+\d{2}$", 1).try_cast("int") + 2000
    week = F.regexp_extract(code, r"^\d{2}[A-Z]+(\d{2})$", 1).try_cast("int")
    return period_label(year, week)


def reference_season(year: Column, week: Column) -> Column:
    """Season whose figures are known: last year's in week 1, else this year's."""
    return F.when(week == 1, year - 1).otherwise(year)
