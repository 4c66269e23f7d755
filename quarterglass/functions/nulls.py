"""Missing stays missing: helpers that keep NULL apart from zero, false and NaN."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The only texts read as booleans.
TRUE_TEXTS = ("True", "TRUE")
FALSE_TEXTS = ("False", "FALSE")


def is_true(condition: Column) -> Column:
    """Two-valued version of a predicate: NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def finite_or_null(value: Column) -> Column:
    """NULL for NaN and for both infinities."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0.0))


def positive_or_null(value: Column) -> Column:
    return F.when(value > 0, value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL, not infinite, on a zero denominator."""
    return F.try_divide(numerator, denominator)


def text_boolean(text: Column) -> Column:
    """Only the listed literals; a cast would also accept 't', '1' or 'yes'."""
    return F.when(text.isin(*TRUE_TEXTS), F.lit(True)).when(text.isin(*FALSE_TEXTS), F.lit(False))


def all_present(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names], F.lit(True))


def count_true(condition: Column) -> Column:
    return F.count_if(is_true(condition))
