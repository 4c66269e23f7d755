"""A shared session and the small literal inputs of the tests."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from quarterglass.session import local_session
from quarterglass.settings import DEFAULTS

SF = "/root/testdata/sf0.001"
FIRMS = ("ELM", "FIR", "OAK")
#: Stays in the index as (first quarter, number of quarters); None where the stay goes on.
STAYS = {"ELM": [(190, 5)], "FIR": [(187, None)], "OAK": [(179, 9), (188, 3), (196, None)], "YEW": [(193, 0)], "ASH": [(200, 1), (198, 1)]}


def quarter(ordinal: int) -> str:
    return f"{1970 + ordinal // 4}Q{ordinal % 4 + 1}"


RANGES = [(name, quarter(first), "" if n is None else quarter(first + n)) for name, stays in STAYS.items() for first, n in stays]


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF).exists():
        pytest.skip("test tables not available")
    return SF


def panel_frame() -> pd.DataFrame:
    """Ten quarters from 2018Q1 of the three tickers, every measure an integer formula of quarter and ticker.

    Remainders by primes keep the measures apart and without a trend; the two stored ratios hold two decimals.
    """
    n = np.arange(10 * len(FIRMS))
    step, unit = n // len(FIRMS), n % len(FIRMS)
    spread = lambda prime, factor: (n * factor + unit * 5 + 3) % prime
    q_ord = 192 + step
    starts = pd.PeriodIndex.from_ordinals(q_ord, freq="Q")
    out = pd.DataFrame({"q_ord": q_ord, "symbol": np.take(FIRMS, unit), "period_key": starts.astype(str)})
    out["KEY"] = out["period_key"].str.cat(out["symbol"], sep="_")
    out["fiscal_period_end_date"] = starts.end_time.date
    out["run_date"] = dt.date(2026, 9, 5)
    out["sector"], out["company"] = "Tools", "Maker of " + out["symbol"]
    invested = 600.0 + 8 * spread(97, 41)
    profit, taxed = 70 + spread(53, 17) / 2, 55 + spread(59, 29) / 2
    out["calc_average_ic_raw_quarterly"], out["ebit"], out["calc_nopat_quarterly"] = invested, profit, taxed
    out["calc_roic_pretax_quarterly_ic_raw"] = np.floor(profit / invested * 100 + 0.5) / 100
    out["calc_roic_posttax_quarterly_ic_raw"] = np.floor(taxed / invested * 100 + 0.5) / 100
    for name, prime in (("ebit", 31), ("tax", 37), ("ic", 43)):
        out[f"calc_roic_{name}_contribution"] = (spread(prime, 11) - prime // 2) / 2048
    out["calc_roic_decomposition_status"], out["calc_roic_economic_interpretation_valid"] = "VALID", True
    out["calc_debt_value_quarterly"] = 30.0 + 5 * spread(61, 7)
    out["total_stockholders_equity"] = 150.0 + 9 * spread(67, 13)
    out["market_cap"] = 2000.0 + 700 * spread(71, 19)
    out["valuations__per_share_data__month_end_stock_price"] = 12 + spread(83, 23) / 4
    out["Future_Quarterly_Return"], out["Momentum_3Q"] = (spread(41, 9) - 17) / 256, (spread(47, 15) - 20) / 128
    return out


def to_spark(spark, frame: pd.DataFrame):
    """pandas NaN becomes NULL."""
    types = {"symbol": "string", "q_ord": "int", "fiscal_period_end_date": "date", "run_date": "date"}
    types |= {c: "string" for c in ("company", "sector", "period_key", "KEY", "calc_roic_decomposition_status")}
    types |= {"calc_roic_economic_interpretation_valid": "boolean"}
    schema = ", ".join(f"`{c}` {types.get(c, 'double')}" for c in frame.columns)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def panel(spark):
    return to_spark(spark, panel_frame())


def ranges_frame(spark, rows=None):
    from quarterglass.sources.ranges import type_ranges

    rows = RANGES if rows is None else rows
    text = spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)], "ticker string, start_quarter string, end_quarter string, range_id long"
    )
    return type_ranges(text, DEFAULTS.load)


@pytest.fixture()
def ranges(spark):
    return ranges_frame(spark)
