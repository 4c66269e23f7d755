"""Row order inside an entity: gaps, links and unbroken windows.

One window specification (symbol, q_ord) serves every operator of the
package, so Spark plans a single exchange and a single sort for all of them.
An entity holds at most one row per quarter (``require_unique`` checks it),
which bounds a window group by the number of quarters however skewed the
underlying transactions are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarterglass.functions.nulls import is_true
from quarterglass.settings import SequenceRule


def by_entity(symbol: str = "symbol", order: str = "q_ord") -> WindowSpec:
    return Window.partitionBy(symbol).orderBy(order)


def add_sequence_info(panel: DataFrame, rule: SequenceRule, fiscal_end: str = "fiscal_period_end_date") -> DataFrame:
    """prev_key_gap, prev_day_gap, is_consecutive_prev."""
    w = by_entity()
    gaps = panel.withColumns(
        {
            "prev_key_gap": F.col("q_ord") - F.lag("q_ord").over(w),
            "prev_day_gap": F.datediff(fiscal_end, F.lag(fiscal_end).over(w)),
        }
    )
    linked = (F.col("prev_key_gap") == rule.key_gap) & F.col("prev_day_gap").between(rule.min_days, rule.max_days)
    return gaps.withColumn("is_consecutive_prev", is_true(linked))


def lag_name(column: str, k: int) -> str:
    return f"__{column}_lag{k}" if k else column


def add_lags(panel: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """One column per (name, lag 1..depth); all of them land in one Window node."""
    w = by_entity()
    lags = {
        lag_name(name, k): F.lag(name, k).over(w) for name, depth in wanted.items() for k in range(1, depth + 1)
    }
    return panel.withColumns(lags)


def drop_lags(panel: DataFrame) -> DataFrame:
    return panel.drop(*[c for c in panel.columns if c.startswith("__") and "_lag" in c])


def lagged(column: str, rows: int) -> list[Column]:
    """Values at t-(rows-1) .. t, oldest first; needs ``add_lags`` before."""
    return [F.col(lag_name(column, k)) for k in range(rows - 1, -1, -1)]


def unbroken(rows: int, link: str = "is_consecutive_prev") -> Column:
    """True when the last ``rows`` rows form a run of linked quarters (W2); needs lags of ``link``."""
    links = [is_true(F.col(lag_name(link, k))) for k in range(rows - 1)]
    return reduce(lambda a, b: a & b, links, F.lit(True))


def add_window_sum(panel: DataFrame, column: str, rows: int) -> DataFrame:
    """``<column>_sum``: the sum over the last ``rows`` rows, NULL if one is missing."""
    summed = reduce(lambda a, b: a + b, lagged(column, rows))
    return drop_lags(add_lags(panel, {column: rows - 1}).withColumn(f"{column}_sum", summed))


def first_rows(panel: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows of every entity."""
    ranked = panel.withColumn("__rn", F.row_number().over(by_entity()))
    return ranked.filter(F.col("__rn") <= n).drop("__rn")
