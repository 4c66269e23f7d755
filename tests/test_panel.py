"""Composite panel: nulls, row accounting, look-ahead."""

import datetime as dt
import inspect

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarterglass.operators import membership, sequence, signals
from quarterglass.operators.timing import as_of_table
from quarterglass.operators.uniqueness import _packed_keys, duplicated_rows, duplicates_report, multiset_difference, require_unique
from quarterglass.plans.research_panel import build_research_panel, signal_panel
from quarterglass.settings import DEFAULTS as S
from quarterglass.settings import PanelSettings, TimingRule, TrendRule
from tests.conftest import panel_frame, to_spark


def build(spark, ranges, frame, settings=S):
    return build_research_panel(to_spark(spark, frame), ranges, settings)


def ordered(panel) -> pd.DataFrame:
    return panel.toPandas().sort_values("KEY").reset_index(drop=True)


def test_rows_and_keys_are_preserved(spark, ranges):
    frame = panel_frame()
    out = build(spark, ranges, frame)
    assert sorted(r.KEY for r in out.select("KEY").collect()) == sorted(frame["KEY"])


def test_duplicates_are_rejected_and_reported(spark, ranges, panel):
    double = panel.unionByName(panel.limit(1))
    with pytest.raises(ValueError, match="share"):
        build_research_panel(double, ranges)
    require_unique(panel)
    report = {r.key: r for r in duplicates_report(double).collect()}
    assert report["KEY"].duplicated_rows == 2 and report["KEY"].examples.count("; ") == 1
    assert duplicated_rows(double, ["symbol", "q_ord"]).count() == 2


def test_null_keys_count_as_equal(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), ("a", 1)], "symbol string, q_ord int")
    assert duplicated_rows(rows, ["symbol", "q_ord"]).count() == 2


@pytest.mark.parametrize(
    ("field", "levels"),
    [("calc_average_ic_raw_quarterly", {"roic_pretax_q", "roic_posttax_q"}), ("total_stockholders_equity", {"debt_to_equity_q"}), ("ebit", set())],
)
def test_a_zero_below_the_line_gives_null_and_nothing_else_does(spark, ranges, field, levels):
    frame = panel_frame()
    zero = frame.index % 4 == 2
    frame.loc[zero, field] = 0.0
    out = ordered(build(spark, ranges, frame)).set_index("KEY")
    for level in ("roic_pretax_q", "roic_posttax_q", "debt_to_equity_q"):
        assert set(out.index[out[level].isna()]) == (set(frame.loc[zero, "KEY"]) if level in levels else set()), level


@pytest.mark.parametrize("source", ["recompute", "file"])
def test_file_null_pattern_is_authoritative(spark, ranges, source):
    frame, rounded = panel_frame(), "calc_roic_posttax_quarterly_ic_raw"
    empty = frame.index % 7 == 3
    frame.loc[empty, rounded] = np.nan
    out = ordered(build(spark, ranges, frame, PanelSettings(trend=TrendRule(level_source=source)))).set_index("KEY")
    frame = frame.set_index("KEY")
    exact = frame["calc_nopat_quarterly"] / frame["calc_average_ic_raw_quarterly"]
    expected = frame[rounded] if source == "file" else exact.where(frame[rounded].notna())
    assert out["roic_posttax_q"].to_numpy() == pytest.approx(expected.loc[out.index].to_numpy(), nan_ok=True)
    with pytest.raises(ValueError):
        TrendRule(level_source="guess")


def test_timing_and_return_cleaning(spark, ranges):
    frame = panel_frame()
    frame.loc[frame.KEY == "2018Q1_ELM", ["Future_Quarterly_Return", "Momentum_3Q", "market_cap"]] = 0.0
    settings = PanelSettings(timing=TimingRule(data_as_of=dt.date(2020, 6, 30)))
    rows = {r.KEY: r for r in build(spark, ranges, frame, settings).collect()}
    first, last = rows["2018Q1_ELM"], rows["2020Q2_ELM"]
    assert first.formation_date == dt.date(2018, 5, 31) and first.return_window_end == dt.date(2018, 8, 31)
    assert first.signal_lag_days == 61 and first.signal_lag_months == 2 and not first.signal_lag_below_min
    assert first.fwd_return == 0.0 and first.fwd_return_exact_zero_realized
    assert first.momentum_3q_clean is None and first.momentum_3q_exact_zero
    assert first.market_cap_clean is None and first.market_cap == 0.0
    assert last.fwd_return_window_unrealized and last.fwd_return is None and last.Future_Quarterly_Return is not None


def test_as_of_is_required(spark, panel):
    assert as_of_table(panel, S).first().data_as_of == dt.date(2026, 9, 5)
    with pytest.raises(Exception, match="data_as_of"):
        as_of_table(panel.withColumn("run_date", F.lit(None).cast("date")), S).collect()


def test_future_rows_do_not_change_past_signals(spark, ranges):
    frame = panel_frame()
    shocked = frame.copy()
    future = shocked["q_ord"] > 196
    for name in ("ebit", "calc_nopat_quarterly", "calc_average_ic_raw_quarterly", "calc_roic_tax_contribution"):
        shocked.loc[future, name] *= 5
    names = ["KEY", *S.trend.feature_columns(), "in_population"]
    old, new = (ordered(build(spark, ranges, f).filter("q_ord <= 196").select(*names)) for f in (frame, shocked))
    pd.testing.assert_frame_equal(old, new)


def test_returns_do_not_change_signals(spark, ranges):
    frame = panel_frame()
    noisy = frame.assign(Future_Quarterly_Return=np.random.default_rng(1).normal(size=len(frame)))
    noisy.loc[::3, "Future_Quarterly_Return"] = np.nan
    names = ["KEY", *S.trend.feature_columns(), "in_population", "has_level_and_trend_signals"]
    old, new = (ordered(build(spark, ranges, f).select(*names)) for f in (frame, noisy))
    pd.testing.assert_frame_equal(old, new)
    bare = to_spark(spark, frame.drop(columns=["Future_Quarterly_Return", "Momentum_3Q"]))
    assert signal_panel(bare, ranges).count() == 30


def test_signal_modules_never_name_returns():
    for module in (signals, membership, sequence):
        source = inspect.getsource(module)
        assert not any(w in source for w in ("forward_return", "fwd_return", "Future_Quarterly_Return", "momentum"))


def test_plan_has_one_exchange_and_one_sort_by_entity(spark, ranges, panel, sf_dir):
    from quarterglass.sources import trade_panel as TP

    stored = TP.panel(spark, sf_dir)
    plan = signal_panel(stored, TP.ranges(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and plan.count("Sort [symbol") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_no_table_of_all_entities_goes_to_every_task(spark, sf_dir):
    """Tables with rows per entity are dealt, however small their files are; the panel is still dealt and sorted once."""
    from quarterglass.sources import trade_panel as TP

    statements = TP.raw_statements(spark, sf_dir)
    panel = signal_panel(TP.panel(spark, sf_dir), TP.ranges(spark, sf_dir))
    for frame in (statements, statements.select("symbol", "ebit"), panel):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "ShuffledHashJoin" in plan


def test_multiset_difference(spark):
    """Repeats, NULLs and keys of one side alone, whatever the pieces and buckets; a key that is lost is not made up for by another."""
    before = ["a"] * 5 + ["b", "c", None, None] + [f"k{i}" for i in range(300)]
    after = ["a"] * 3 + ["b", "b", "d", None] + [f"k{i}" for i in range(300)]
    frames = [spark.createDataFrame([(k,) for k in keys], "KEY string").repartition(n) for keys, n in ((before, 5), (after, 3))]
    for buckets in (1, 7, 1024):
        assert [tuple(r) for r in multiset_difference(*frames, "KEY", buckets).collect()] == [(309, 4, 2)]
    assert [tuple(r) for r in multiset_difference(frames[0].limit(0), frames[1].limit(0), "KEY").collect()] == [(0, 0, 0)]
    # tasks hold no table of all keys: sums are by piece, and the only exchange by key is of buckets
    plan = multiset_difference(*frames, "KEY")._jdf.queryExecution().executedPlan().toString()
    assert "keys=[KEY" not in plan and "hashpartitioning(bucket" in plan
    batch = pa.RecordBatch.from_pydict({"bucket": pa.array([1, 0, 1], pa.int32()), "key": ["x", "y", "x"], "b": [1, 1, 1], "a": [0, 0, 0]})
    pieces = [b.to_pylist() for b in _packed_keys(iter([batch, batch]), rows=3)]
    assert len(pieces) == 2 and {"bucket": 1, "key": ["x"], "b": [2], "a": [0]} in pieces[0]
