"""Research parameters as frozen dataclasses; one place for names and thresholds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Columns:
    """Panel column names (fixed values: the panel's public schema)."""

    key: str = "KEY"
    symbol: str = "symbol"
    company: str = "company"
    sector: str = "sector"
    industry: str = "industry"
    period_key: str = "period_key"
    fiscal_end: str = "fiscal_period_end_date"
    filing_date: str = "filing_date"
    run_date: str = "run_date"
    forward_return: str = "Future_Quarterly_Return"
    momentum: str = "Momentum_3Q"
    price: str = "valuations__per_share_data__month_end_stock_price"
    market_cap: str = "market_cap"
    ebit: str = "ebit"
    nopat: str = "calc_nopat_quarterly"
    tax_expense: str = "calc_tax_expense_quarterly"
    tax_rate: str = "calc_raw_tax_rate_quarterly"
    pretax_income: str = "pretax_income"
    ic_raw: str = "calc_ic_raw"
    avg_ic: str = "calc_average_ic_raw_quarterly"
    roic_pretax_file: str = "calc_roic_pretax_quarterly_ic_raw"
    roic_posttax_file: str = "calc_roic_posttax_quarterly_ic_raw"
    roic_annualized: str = "calc_roic_posttax_annualized_ic_raw"
    roic_change: str = "calc_roic_posttax_change_quarterly"
    c_ebit: str = "calc_roic_ebit_contribution"
    c_tax: str = "calc_roic_tax_contribution"
    c_ic: str = "calc_roic_ic_contribution"
    residual: str = "calc_roic_decomposition_residual"
    decomposition_status: str = "calc_roic_decomposition_status"
    quality_flag: str = "calc_roic_quality_flag"
    econ_valid: str = "calc_roic_economic_interpretation_valid"
    debt: str = "calc_debt_value_quarterly"
    stockholders_equity: str = "total_stockholders_equity"
    de_file: str = "calc_debt_to_equity_quarterly"
    de_reported: str = "valuations__ratios__debt_to_equity"


@dataclass(frozen=True)
class LoadRule:
    period_key_regex: str = r"^\d{4}Q[1-4]$"
    # column -> accepted formats, tried in order; anything else is reported
    date_formats: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("fiscal_period_end_date", ("yyyy-MM-dd", "dd/MM/yyyy")),
        ("filing_date", ("yyyy-MM-dd",)),
        ("run_date", ("yyyy-MM-dd",)),
    )
    boolean_columns: tuple[str, ...] = (
        "calc_roic_has_opposing_effects",
        "calc_roic_economic_interpretation_valid",
        "calc_wacc_inputs_complete",
        "calc_creates_value",
    )
    drop_identical_duplicates: bool = True


@dataclass(frozen=True)
class SequenceRule:
    key_gap: int = 1
    min_days: int = 60
    max_days: int = 130


@dataclass(frozen=True)
class MembershipRule:
    compare_to: str = "period_key"
    start_inclusive: bool = True
    end_inclusive: bool = False
    open_end_is_member: bool = True

    def __post_init__(self) -> None:
        if self.compare_to != "period_key":
            raise ValueError("membership is defined on period_key only")


@dataclass(frozen=True)
class TimingRule:
    quarter_shift_months: int = 2
    return_horizon_months: int = 3
    min_signal_lag_months: int = 2
    data_as_of: dt.date | None = None


@dataclass(frozen=True)
class ReturnRule:
    unrealized_to_null: bool = True
    momentum_zero_to_null: bool = True
    # source column -> derived column in which an exact zero means missing
    zero_means_missing: tuple[tuple[str, str], ...] = (
        ("market_cap", "market_cap_clean"),
        ("valuations__per_share_data__month_end_stock_price", "price_clean"),
    )


@dataclass(frozen=True)
class TrendRule:
    window: int = 4
    level_source: str = "recompute"
    # feature -> column whose slope over the window it is
    trend_inputs: tuple[tuple[str, str], ...] = (
        ("roic_trend_4q", "roic_posttax_q"),
        ("ebit_contribution_trend_4q", "calc_roic_ebit_contribution"),
        ("tax_contribution_trend_4q", "calc_roic_tax_contribution"),
        ("ic_contribution_trend_4q", "calc_roic_ic_contribution"),
    )
    # stem -> column summed and averaged over the window
    window_aggregates: tuple[tuple[str, str], ...] = (
        ("ebit_contribution", "calc_roic_ebit_contribution"),
        ("tax_contribution", "calc_roic_tax_contribution"),
        ("ic_contribution", "calc_roic_ic_contribution"),
    )
    raw_ic_change: bool = True

    def __post_init__(self) -> None:
        if self.level_source not in ("recompute", "file"):
            raise ValueError(f"unknown level_source: {self.level_source}")

    @property
    def main_trend(self) -> str:
        return f"roic_trend_{self.window}q"

    def feature_columns(self) -> list[str]:
        """Names of all signal columns, in report order."""
        w = self.window
        names = ["roic_pretax_q", "roic_posttax_q", "debt_to_equity_q"]
        names += [feature for feature, _ in self.trend_inputs]
        for stem, _ in self.window_aggregates:
            names += [f"{stem}_sum_{w}q", f"{stem}_mean_{w}q"]
        names.append(f"roic_change_{w}q")
        if self.raw_ic_change:
            names += [f"avg_ic_change_{w}q", f"avg_ic_pct_change_{w}q", f"avg_ic_trend_{w}q_rel"]
        names += [f"n_decomp_valid_{w}q", f"n_econ_valid_{w}q", f"n_positive_avg_ic_{w}q"]
        return names + [f"all_econ_valid_{w}q", f"window_ok_{w}q", f"window_ok_{w + 1}q"]

    def numeric_features(self) -> list[str]:
        return [n for n in self.feature_columns() if not n.startswith(("window_ok", "all_econ"))]


@dataclass(frozen=True)
class PrecisionRule:
    step_2dp: float = 0.005
    step_6dp: float = 0.0000005
    max_decimals_rounded: int = 2
    decimals_checked: int = 9


@dataclass(frozen=True)
class PanelSettings:
    columns: Columns = field(default_factory=Columns)
    load: LoadRule = field(default_factory=LoadRule)
    sequence: SequenceRule = field(default_factory=SequenceRule)
    membership: MembershipRule = field(default_factory=MembershipRule)
    timing: TimingRule = field(default_factory=TimingRule)
    returns: ReturnRule = field(default_factory=ReturnRule)
    trend: TrendRule = field(default_factory=TrendRule)
    precision: PrecisionRule = field(default_factory=PrecisionRule)
    benchmarks: tuple[str, ...] = ("SPY", "QQQ")


DEFAULTS = PanelSettings()
