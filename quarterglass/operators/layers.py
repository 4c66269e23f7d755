"""Sample layers: raw rows, signal population, evaluation rows.

The population never looks at returns; only the evaluation flag does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterglass.functions.nulls import all_present
from quarterglass.settings import PanelSettings


def add_population(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Benchmark and population flags plus signal availability."""
    trend = settings.trend
    contributions = [feature for feature, _ in trend.trend_inputs if feature != trend.main_trend]
    benchmark = F.col("symbol").isin(*settings.benchmarks)
    return panel.withColumns(
        {
            "is_benchmark": benchmark,
            "in_population": ~benchmark & F.col("in_index"),
            "has_roic_pretax_level": F.col("roic_pretax_q").isNotNull(),
            "has_roic_posttax_level": F.col("roic_posttax_q").isNotNull(),
            "has_roic_trend": F.col(trend.main_trend).isNotNull(),
            "has_all_contribution_trends": all_present(contributions),
            "has_level_and_trend_signals": all_present(["roic_pretax_q", "roic_posttax_q", trend.main_trend]),
        }
    )


def add_evaluation_flag(panel: DataFrame) -> DataFrame:
    realised = F.col("in_population") & F.col("fwd_return").isNotNull()
    return panel.withColumn("in_evaluation_sample", realised)


def add_sample_layers(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    return add_evaluation_flag(add_population(panel, settings))


def benchmark_series(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Benchmark rows with their return columns."""
    c = settings.columns
    names = ["symbol", "period_key", "formation_date", "return_window_end", c.fiscal_end, "fwd_return"]
    names += ["fwd_return_window_unrealized", "momentum_3q_clean", c.forward_return, c.momentum]
    return panel.filter("is_benchmark").select(*names).orderBy("symbol", "period_key")


def research_view(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Company rows with the documented column list, repeats removed."""
    c = settings.columns
    names = ["KEY", "symbol", "company", "sector", "industry", "period_key", c.fiscal_end, "formation_date"]
    names += ["return_window_end", "signal_lag_days", "signal_lag_months", "signal_lag_below_min", "in_index"]
    names += ["in_population", "prev_key_gap", "prev_day_gap", "is_consecutive_prev", c.decomposition_status]
    names += [c.quality_flag, c.econ_valid, c.avg_ic, "market_cap", "market_cap_clean"]
    names += settings.trend.feature_columns() + [c.c_ebit, c.c_tax, c.c_ic, "fwd_return"]
    names += ["fwd_return_window_unrealized", "momentum_3q_clean", "in_evaluation_sample"]
    names += ["has_level_and_trend_signals", "has_all_contribution_trends"]
    return panel.filter(~F.col("is_benchmark")).select(*dict.fromkeys(names))
