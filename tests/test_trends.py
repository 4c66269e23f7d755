import numpy as np
import pandas as pd
import pytest

from quarterglass.functions.measures import slope_weights
from quarterglass.operators.sequence import add_sequence_info, first_rows
from quarterglass.operators.signals import add_levels, add_trend_features
from quarterglass.settings import DEFAULTS as S
from tests.conftest import panel_frame, to_spark


def features(spark, frame: pd.DataFrame) -> pd.DataFrame:
    rows = add_sequence_info(to_spark(spark, frame), S.sequence)
    rows = add_trend_features(add_levels(rows, S.columns, S.trend), S.columns, S.trend)
    return rows.toPandas().sort_values(["symbol", "q_ord"]).set_index(["symbol", "period_key"])


def variants(change) -> pd.DataFrame:
    """The ten quarters of one firm, once for each quarter k as a firm Tk that ``change(rows, k)`` has altered there."""
    own = panel_frame().query("symbol == 'OAK'").reset_index(drop=True)
    made = [change(own.assign(symbol=f"T{k}", KEY=own["period_key"] + f"_T{k}"), k) for k in range(len(own))]
    return pd.concat(made, ignore_index=True)


def windows(k: int, rows: int = 4, n: int = 10) -> list[bool]:
    """Which of n rows have a window of ``rows`` rows that is whole and free of row k."""
    return [t >= rows - 1 and not t - rows < k <= t for t in range(n)]


def test_slope_equals_least_squares(spark):
    out = features(spark, panel_frame())
    for _, rows in out.groupby(level=0):
        y, slope = rows["roic_posttax_q"].to_numpy(), rows["roic_trend_4q"].to_numpy()
        fitted = [np.polynomial.polynomial.polyfit(range(4), y[t : t + 4], 1)[1] for t in range(len(y) - 3)]
        assert np.isnan(slope[:3]).all() and slope[3:] == pytest.approx(fitted, abs=1e-12)


@pytest.mark.parametrize("step", [-0.25, 0.0, 0.0625])
def test_slope_of_a_line_is_its_step(spark, step):
    frame = panel_frame().assign(calc_average_ic_raw_quarterly=1.0)
    frame["calc_nopat_quarterly"] = 3 + step * frame["q_ord"]
    out = features(spark, frame)["roic_trend_4q"].dropna()
    assert len(out) == 3 * 7 and np.allclose(out, step, atol=1e-12)


def test_a_missing_value_breaks_the_windows_that_hold_it(spark):
    def change(rows, k):
        rows.loc[k, ["calc_nopat_quarterly", "calc_roic_posttax_quarterly_ic_raw"]] = np.nan
        return rows

    out = features(spark, variants(change))
    for k in range(10):
        assert out.loc[f"T{k}", "roic_trend_4q"].notna().tolist() == windows(k), k


def test_a_missing_quarter_breaks_the_windows_across_it(spark):
    out = features(spark, variants(lambda rows, k: rows.drop(index=k)))
    for k in range(10):
        own = out.loc[f"T{k}"]
        expected = [t - 3 > k or t < k and t >= 3 for t in range(10) if t != k]
        if k == 0:
            expected = [t >= 4 for t in range(1, 10)]
        assert own["roic_trend_4q"].notna().tolist() == expected, k
        assert own["prev_key_gap"].dropna().tolist() == [2.0 if t == k + 1 else 1.0 for t in range(10) if t != k][1:], k


@pytest.mark.parametrize(("days", "linked"), [(0, True), (-20, True), (-40, False), (50, False)])
def test_days_between_ends_break_windows_too(spark, days, linked):
    """An end moved out of reach unlinks its own quarter or the next, by the days between them."""

    def change(rows, k):
        rows.loc[k, "fiscal_period_end_date"] = rows.loc[k, "fiscal_period_end_date"] + pd.Timedelta(days=days)
        return rows

    frame = variants(change)
    out = features(spark, frame)
    for k in range(1, 9):
        own, ends = out.loc[f"T{k}"], pd.to_datetime(frame.loc[frame.symbol == f"T{k}", "fiscal_period_end_date"])
        far = ends.diff().dt.days.to_numpy()[1:]
        expected = [False, *((far >= S.sequence.min_days) & (far <= S.sequence.max_days))]
        assert own["is_consecutive_prev"].tolist() == expected and all(expected[1:]) == linked, k
        assert own["roic_trend_4q"].notna().tolist() == [t >= 3 and all(expected[t - 2 : t + 1]) for t in range(10)], k


def test_windows_stay_inside_an_entity(spark, panel):
    heads = first_rows(add_sequence_info(panel, S.sequence), 3).collect()
    assert len(heads) == 9
    out = features(spark, panel_frame())
    assert out.groupby(level=0).head(3)["roic_trend_4q"].isna().all()


def test_sum_mean_changes_and_counts(spark):
    out = features(spark, panel_frame()).loc["FIR"]
    values = out["calc_roic_tax_contribution"].to_numpy()
    assert out["tax_contribution_sum_4q"].iloc[5] == pytest.approx(values[2:6].sum())
    assert out["tax_contribution_mean_4q"].iloc[5] == pytest.approx(values[2:6].mean())
    ic = out["calc_average_ic_raw_quarterly"].to_numpy()
    assert out["avg_ic_change_4q"].iloc[4] == pytest.approx(ic[4] - ic[0]) and np.isnan(out["avg_ic_change_4q"].iloc[3])
    assert out["avg_ic_pct_change_4q"].iloc[9] == pytest.approx(ic[9] / ic[5] - 1)
    assert out["n_econ_valid_4q"].iloc[3] == 4 and out["all_econ_valid_4q"].iloc[3]


def test_slope_weights():
    assert slope_weights(4) == [-0.3, -0.1, 0.1, 0.3]
    assert sum(slope_weights(7)) == pytest.approx(0)
