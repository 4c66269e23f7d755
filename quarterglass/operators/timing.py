"""When a signal can be traded, and which forward returns have happened yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterglass.functions.nulls import count_true, is_true, zero_to_null
from quarterglass.functions.quarters import month_end_after, month_index
from quarterglass.settings import PanelSettings, TimingRule


def add_timing(panel: DataFrame, rule: TimingRule, fiscal_end: str = "fiscal_period_end_date") -> DataFrame:
    """Formation date, end of the return window and signal lag."""
    shift = rule.quarter_shift_months
    dated = panel.withColumns(
        {
            "formation_date": month_end_after(F.col("q_ord"), shift),
            "return_window_end": month_end_after(F.col("q_ord"), shift + rule.return_horizon_months),
        }
    )
    lag_months = month_index(F.col("formation_date")) - month_index(F.col(fiscal_end))
    return dated.withColumns(
        {
            "signal_lag_days": F.datediff("formation_date", fiscal_end),
            "signal_lag_months": lag_months,
            "signal_lag_below_min": is_true(lag_months < rule.min_signal_lag_months),
        }
    )


def as_of_table(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """One row: the configured as-of date, or the latest run date; an error when neither exists."""
    given = settings.timing.data_as_of
    latest = F.lit(given) if given else F.max(settings.columns.run_date)
    missing = F.raise_error(F.lit("no data_as_of given and run_date has no values")).cast("date")
    return panel.agg(F.coalesce(latest, missing).alias("data_as_of"))


def as_of_column(panel: DataFrame, settings: PanelSettings) -> Column:
    """The as-of date as a scalar subquery: evaluated once, no join in the plan."""
    return as_of_table(panel, settings).scalar()


def clean_returns(panel: DataFrame, settings: PanelSettings, as_of: Column) -> DataFrame:
    """Undo zero-coding of missing returns, momentum, size and price.

    The cleaned momentum is ``momentum_3q_clean``: Spark resolves names without
    regard to case, so it cannot share the letters of the source column.
    """
    c, rule = settings.columns, settings.returns
    raw = F.col(c.forward_return)
    momentum = F.col(c.momentum)
    pending = F.col("fwd_return_window_unrealized")
    out = panel.withColumn("fwd_return_window_unrealized", is_true(F.col("return_window_end") > as_of))
    derived = {
        "fwd_return": F.when(~pending, raw) if rule.unrealized_to_null else raw,
        "fwd_return_exact_zero_realized": ~pending & is_true(raw == 0),
        "momentum_3q_exact_zero": is_true(momentum == 0),
        "momentum_3q_clean": zero_to_null(momentum) if rule.momentum_zero_to_null else momentum,
    }
    for source, target in rule.zero_means_missing:
        derived[target] = zero_to_null(F.col(source))
    return out.withColumns(derived)


def returns_report(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Counts of what ``clean_returns`` changed, in one row."""
    raw = F.col(settings.columns.forward_return)
    pending = F.col("fwd_return_window_unrealized")
    company = ~F.col("symbol").isin(*settings.benchmarks)
    counts = [
        F.count_if(pending).alias("rows_unrealized_window"),
        count_true(pending & (raw == 0)).alias("unrealized_exact_zero"),
        count_true(pending & raw.isNull()).alias("unrealized_null"),
        count_true(pending & (raw != 0)).alias("unrealized_other"),
        F.count_if("fwd_return_exact_zero_realized").alias("realized_exact_zero_kept"),
        F.count_if("momentum_3q_exact_zero").alias("momentum_exact_zero"),
    ]
    for source, target in settings.returns.zero_means_missing:
        zero = F.col(source) == 0
        counts.append(count_true(zero).alias(f"{target}_zeros"))
        counts.append(count_true(zero & company).alias(f"{target}_zeros_company"))
    return panel.agg(*counts)


def unrealized_by_period(panel: DataFrame) -> DataFrame:
    """Rows with an open return window per quarter."""
    return panel.filter("fwd_return_window_unrealized").groupBy("period_key").agg(F.count(F.lit(1)).alias("rows"))
