"""Ratio levels and window signals. Only past and present rows of one entity are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterglass.functions.measures import slope_weights, total
from quarterglass.functions.nulls import is_true, positive_or_null, ratio
from quarterglass.operators.sequence import add_lags, drop_lags, lag_name, lagged, unbroken
from quarterglass.settings import Columns, TrendRule


def level_pairs(c: Columns) -> tuple[tuple[str, str, str], ...]:
    """(derived level, numerator, rounded column of the file)."""
    return (
        ("roic_pretax_q", c.ebit, c.roic_pretax_file),
        ("roic_posttax_q", c.nopat, c.roic_posttax_file),
    )


def add_levels(panel: DataFrame, c: Columns, rule: TrendRule) -> DataFrame:
    """Full-precision quarterly ratios; the file's NULL pattern is authoritative."""
    levels = {}
    for name, numerator, rounded in level_pairs(c):
        if rule.level_source == "recompute":
            exact = ratio(F.col(numerator), F.col(c.avg_ic))
            levels[name] = F.when(F.col(rounded).isNotNull(), exact)
        else:
            levels[name] = F.col(rounded).cast("double")
    levels["debt_to_equity_q"] = ratio(F.col(c.debt), F.col(c.stockholders_equity))
    return panel.withColumns(levels)


def level_report(panel: DataFrame, c: Columns) -> DataFrame:
    """How the recomputed levels differ from the rounded ones, one row per level."""
    aggregates = []
    for name, numerator, rounded in level_pairs(c):
        exact, stored = ratio(F.col(numerator), F.col(c.avg_ic)), F.col(rounded)
        kept = F.when(stored.isNotNull(), exact)
        aggregates.append(
            F.struct(
                F.lit(name).alias("level"),
                F.count_if(exact.isNotNull() & stored.isNull()).alias("set_null_where_file_null"),
                F.count_if(exact.isNull() & stored.isNotNull()).alias("null_where_file_has_value"),
                F.max(F.abs(kept - stored)).alias("max_abs_dev_vs_rounded_file"),
            )
        )
    return panel.agg(F.array(*aggregates).alias("r")).selectExpr("inline(r)")


def slope(column: str, window: int) -> Column:
    """Least-squares slope over the last ``window`` rows, NULL if one value is missing."""
    return total([F.lit(weight) * y for weight, y in zip(slope_weights(window), lagged(column, window))])


def window_sum(column: str, window: int) -> Column:
    """NULL-strict rolling sum."""
    return total(lagged(column, window))


def add_trend_features(panel: DataFrame, c: Columns, rule: TrendRule) -> DataFrame:
    """The whole trend block from one shared set of lag columns."""
    w = rule.window
    flags = {
        "__decomp": is_true(F.col(c.decomposition_status) == "VALID").cast("int"),
        "__econ": is_true(F.col(c.econ_valid)).cast("int"),
        "__icpos": (F.col(c.avg_ic) > 0).cast("int"),
    }
    depth = {"is_consecutive_prev": w - 1, "roic_posttax_q": w, c.avg_ic: w}
    for _, source in (*rule.trend_inputs, *rule.window_aggregates):
        depth[source] = max(depth.get(source, 0), w - 1)
    depth |= {name: w - 1 for name in flags}
    wide = add_lags(panel.withColumns(flags), depth)

    whole, longer = unbroken(w), unbroken(w + 1)
    out: dict[str, Column] = {f"window_ok_{w}q": whole, f"window_ok_{w + 1}q": longer}
    for feature, source in rule.trend_inputs:
        out[feature] = F.when(whole, slope(source, w))
    for stem, source in rule.window_aggregates:
        summed = F.when(whole, window_sum(source, w))
        out[f"{stem}_sum_{w}q"], out[f"{stem}_mean_{w}q"] = summed, summed / w
    out[f"roic_change_{w}q"] = F.when(longer, F.col("roic_posttax_q") - F.col(lag_name("roic_posttax_q", w)))
    if rule.raw_ic_change:
        now, base = F.col(c.avg_ic), F.col(lag_name(c.avg_ic, w))
        mean = positive_or_null(window_sum(c.avg_ic, w) / w)
        out[f"avg_ic_change_{w}q"] = F.when(longer, now - base)
        out[f"avg_ic_pct_change_{w}q"] = F.when(longer, now / positive_or_null(base) - 1)
        out[f"avg_ic_trend_{w}q_rel"] = F.when(whole, slope(c.avg_ic, w)) / mean
    for name, flag in (("n_decomp_valid", "__decomp"), ("n_econ_valid", "__econ"), ("n_positive_avg_ic", "__icpos")):
        hits = total([F.coalesce(v, F.lit(0)) for v in lagged(flag, w)])
        out[f"{name}_{w}q"] = F.when(whole, hits)
    done = wide.withColumns(out).withColumn(f"all_econ_valid_{w}q", is_true(F.col(f"n_econ_valid_{w}q") == w))
    return drop_lags(done).drop(*flags)
