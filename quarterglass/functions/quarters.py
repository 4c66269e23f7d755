"""Calendar quarters as integers (quarters since 1970Q1) and 'YYYYQn' labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_key(text: Column, regex: str) -> Column:
    """Trimmed key when it matches ``regex`` in full, else NULL."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(regex), trimmed)


def key_ordinal(key: Column) -> Column:
    """'1970Q1' -> 0; NULL stays NULL."""
    year = F.substring(key, 1, 4).cast("int")
    quarter = F.substring(key, 6, 1).cast("int")
    return (year - 1970) * 4 + quarter - 1


def date_ordinal(day: Column) -> Column:
    return (F.year(day) - 1970) * 4 + F.quarter(day) - 1


def ordinal_year(ordinal: Column) -> Column:
    return F.floor(ordinal / 4).cast("int") + 1970


def ordinal_quarter(ordinal: Column) -> Column:
    return F.pmod(ordinal, F.lit(4)) + 1


def ordinal_key(ordinal: Column) -> Column:
    text = F.concat(ordinal_year(ordinal).cast("string"), F.lit("Q"), ordinal_quarter(ordinal).cast("string"))
    return F.when(ordinal.isNotNull(), text)


def month_end_after(ordinal: Column, months: int) -> Column:
    """Last day of the month ``months`` after the quarter's last month."""
    last_month = F.make_date(ordinal_year(ordinal), ordinal_quarter(ordinal) * 3, F.lit(1))
    return F.last_day(F.add_months(last_month, months))


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def aligned_key(day: Column, shift_months: int) -> Column:
    """Quarter label of the date moved back by ``shift_months``."""
    return ordinal_key(date_ordinal(F.add_months(day, -shift_months)))
