"""The composite entry point: raw panel and ranges to the prepared panel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarterglass.operators.layers import add_evaluation_flag, add_population
from quarterglass.operators.membership import membership, validate_ranges
from quarterglass.operators.sequence import add_sequence_info
from quarterglass.operators.signals import add_levels, add_trend_features
from quarterglass.operators.timing import add_timing, as_of_column, clean_returns
from quarterglass.operators.uniqueness import require_unique
from quarterglass.settings import DEFAULTS, PanelSettings


def signal_panel(raw: DataFrame, ranges: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """Sequence, membership, timing, levels, trends and population; no return column is read."""
    c = settings.columns
    panel = add_sequence_info(raw, settings.sequence, c.fiscal_end)
    panel = membership(panel, ranges, settings.membership)
    panel = add_timing(panel, settings.timing, c.fiscal_end)
    panel = add_levels(panel, c, settings.trend)
    panel = add_trend_features(panel, c, settings.trend)
    return add_population(panel, settings)


def prepared_panel(raw: DataFrame, ranges: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """The whole lazy chain: one exchange and one sort by entity, then projections."""
    panel = clean_returns(signal_panel(raw, ranges, settings), settings, as_of_column(raw, settings))
    return add_evaluation_flag(panel)


def build_research_panel(raw: DataFrame, ranges: DataFrame, settings: PanelSettings = DEFAULTS) -> DataFrame:
    """``prepared_panel`` behind the two fail-fast checks on its inputs."""
    validate_ranges(ranges, settings.membership)
    require_unique(raw)
    return prepared_panel(raw, ranges, settings)
