"""Numeric column expressions shared by signals, audits and the fundamentals chain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterglass.functions.nulls import ratio


def total(parts: Sequence[Column]) -> Column:
    """Left-to-right sum; NULL as soon as one part is NULL."""
    return reduce(lambda a, b: a + b, parts)


def slope_weights(window: int) -> list[float]:
    """Least-squares weights for x = 0 .. window-1; the slope is their dot product with y."""
    centre = (window - 1) / 2.0
    spread = sum((x - centre) ** 2 for x in range(window))
    return [(x - centre) / spread for x in range(window)]


def half_up(value: Column, decimals: int) -> Column:
    """Round half up with plain double arithmetic.

    Beyond 2^52 a double has no fraction left, and floor() would not fit a long.
    """
    scale = float(10**decimals)
    scaled = value * scale
    return F.when(F.abs(scaled) < float(2**52), F.floor(scaled + 0.5) / scale).otherwise(value)


def annualise(quarterly: Column) -> Column:
    """(1 + q)^4 - 1 as two squarings."""
    squared = (1 + quarterly) * (1 + quarterly)
    return squared * squared - 1


def relative_tolerance(reference: Column, step: float = 1e-9) -> Column:
    """``step * max(1, |x|)``, NULL for NULL (greatest() alone would skip it)."""
    return F.when(reference.isNotNull(), F.greatest(F.lit(1.0), F.abs(reference)) * step)


def decimals_needed(value: Column, up_to: int) -> Column:
    """Aggregate: smallest d <= up_to at which every value equals its rounding.

    ``up_to + 1`` when no d fits, -1 when there is no value at all. A value that
    fits d decimals fits d + 1, so the column's need is the largest need of a row.
    """
    tolerance = F.greatest(F.lit(1.0), F.abs(value)) * 1e-9
    need = F.lit(up_to + 1)
    for d in range(up_to, -1, -1):
        scale = float(10**d)
        fits = F.abs(value - F.rint(value * scale) / scale) <= tolerance
        need = F.when(fits, F.lit(d)).otherwise(need)
    return F.coalesce(F.max(F.when(value.isNotNull(), need)), F.lit(-1))


def three_factor_split(
    e0: Column, e1: Column, q0: Column, q1: Column, i0: Column, i1: Column
) -> tuple[Column, Column, Column]:
    """Shapley split of the change in E*Q/I over its three factors.

    A factor's share is its own change times the average of the other two,
    with weight 1/3 on the pure old/new pairs and 1/6 on the mixed ones.
    """

    def blend(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
        pure = (a0 * b0 + a1 * b1) / 3
        mixed = (a1 * b0 + a0 * b1) / 6
        return pure + mixed

    inv0, inv1 = ratio(F.lit(1.0), i0), ratio(F.lit(1.0), i1)
    by_e = (e1 - e0) * blend(q0, q1, inv0, inv1)
    by_q = (q1 - q0) * blend(e0, e1, inv0, inv1)
    by_i = (inv1 - inv0) * blend(e0, e1, q0, q1)
    return by_e, by_q, by_i


def two_factor_split(e0: Column, e1: Column, q0: Column, q1: Column) -> tuple[Column, Column]:
    """Shapley split of the change in E*Q over its two factors."""
    return (e1 - e0) * (q0 + q1) / 2, (q1 - q0) * (e0 + e1) / 2


def materiality(scale: Column, absolute: float, relative: float) -> Column:
    """Change that counts as real: ``max(absolute, relative * |scale|)``."""
    return F.when(scale.isNotNull(), F.greatest(F.lit(absolute), F.abs(scale) * relative))
