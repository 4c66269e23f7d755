"""Batteries of re-derivation checks.

A check compares a stored value with its re-derivation. The whole battery is
one lazy projection, whose deviations are packed once: counts, maxima and
medians of every check come from that shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterglass.functions.measures import annualise, relative_tolerance, three_factor_split
from quarterglass.functions.nulls import is_true, ratio
from quarterglass.functions.quarters import aligned_key, key_ordinal
from quarterglass.operators.packed import facts, pack, quantiles
from quarterglass.operators.sequence import add_lags, lag_name
from quarterglass.settings import Columns, PanelSettings


@dataclass(frozen=True)
class Check:
    """``deviation`` and ``tolerance`` for measured checks, ``passes`` for exact ones."""

    name: str
    reference: str
    tested: Column
    deviation: Column | None = None
    tolerance: Column | float | None = None
    passes: Column | None = None
    note: str = ""

    @property
    def tolerance_text(self) -> str:
        if self.passes is not None:
            return "exact"
        return repr(self.tolerance) if isinstance(self.tolerance, float) else "row-specific (rounding propagated)"


def summarise(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """One line per check: tested, passed, share, largest and median deviation.

    A check has two columns of deviations, of rows that passed and of others, and all columns of the report come from one
    shuffle of their packed values, so ``rows`` is read once however many checks there are.
    """
    outcomes, about = [], []
    for i, check in enumerate(checks):
        if check.passes is not None:
            tested, passed = is_true(check.tested), is_true(check.passes)
            deviation = F.lit(0.0)
        else:
            # a NULL deviation is not tested; a NULL tolerance fails
            deviation = F.when(is_true(check.tested), F.abs(check.deviation))
            tolerance = F.lit(check.tolerance) if isinstance(check.tolerance, float) else check.tolerance
            tested, passed = deviation.isNotNull(), is_true(deviation <= tolerance)
        value = F.coalesce(deviation, F.lit(0.0))
        outcomes += [F.when(tested & passed, value), F.when(tested & ~passed, value)]
        about.append(
            F.struct(
                F.lit(i).alias("fid"), F.lit(check.name).alias("check"), F.lit(check.reference).alias("dictionary_reference"),
                F.lit(check.passes is None).alias("measured"), F.lit(check.tolerance_text).alias("tolerance"), F.lit(check.note).alias("note"),
            )
        )
    packed = pack(rows, outcomes)
    check, n = F.expr("fid div 2").cast("int").alias("fid"), F.col("n")
    own = facts(packed).groupBy(check).agg(
        F.sum("n").alias("n_tested"), F.sum(F.when(F.col("fid") % 2 == 0, n).otherwise(0)).alias("n_pass"), F.max("largest").alias("max_abs_dev")
    )
    medians = quantiles(packed, [0.5], width=2).select("fid", F.col("quantile").alias("median_abs_dev"))
    found = own.join(F.broadcast(medians), "fid", "left")
    found = F.broadcast(found)  # one row per check
    lines = rows.sparkSession.range(1).select(F.inline(F.array(*about))).join(found, "fid", "left").orderBy("fid")
    tested, passed = (F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_tested", "n_pass"))
    shown = [F.when(F.col("measured"), F.col(n)).alias(n) for n in ("max_abs_dev", "median_abs_dev")]
    share = F.try_divide("n_pass", "n_tested").alias("share_pass")
    return lines.select("check", "dictionary_reference", tested, passed, share, *shown, "tolerance", "note")


def failing(checks: DataFrame, minimum: float = 0.999) -> DataFrame:
    """Checks whose pass share is under the gate (Q9)."""
    return checks.filter(F.col("share_pass") < minimum)


def gate(checks: DataFrame, minimum: float = 0.9999) -> DataFrame:
    """One row: do all checks reach the gate?"""
    return checks.agg(is_true(F.bool_and(F.col("share_pass") >= minimum)).alias("all_pass"))


def formula_checks(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Every documented formula on the rounded panel, company rows (Q8); two checks cover all rows.

    ``__company`` restricts the other 21 inside the same pass.
    """
    c, step, step6 = settings.columns, settings.precision.step_2dp, settings.precision.step_6dp
    rate = ratio(F.col(c.tax_expense), F.col(c.pretax_income))
    derived = panel.withColumns({"__company": ~F.col("is_benchmark"), "__rate": rate, "__keep": 1 - rate})
    depth = {c.ic_raw: 1, "roic_posttax_q": 1, c.ebit: 1, "__keep": 1, c.avg_ic: 1}
    rows = add_lags(derived, depth | {c.forward_return: 3, "prev_key_gap": 2})

    col, company = F.col, F.col("__company")

    def before(name: str, k: int = 1) -> Column:
        return F.col(lag_name(name, k))

    t, keep = col("__rate"), col("__keep")
    pretax_size, ic_size = F.abs(c.pretax_income), F.abs(c.avg_ic)
    capital = col("total_current_assets") - col("total_current_liabilities") + col("net_ppe") + col("goodwill")
    valid = col(c.decomposition_status) == "VALID"
    broken = col("prev_key_gap").isNull() | (col("prev_key_gap") != 1)
    by_e, by_q, by_i = three_factor_split(
        before(c.ebit), col(c.ebit), before("__keep"), keep, before(c.avg_ic), col(c.avg_ic)
    )
    debt_parts = col("short_term_debt_and_capital_lease"), col("long_term_debt_and_capital_lease")
    momentum = (1 + before(c.forward_return)) * (1 + before(c.forward_return, 2)) * (1 + before(c.forward_return, 3)) - 1
    three_steps = (col("prev_key_gap") == 1) & (before("prev_key_gap") == 1) & (before("prev_key_gap", 2) == 1)
    level_size = 1 + F.abs("roic_posttax_q")
    rule_key = aligned_key(col(c.fiscal_end), settings.timing.quarter_shift_months)
    year_quarter = F.concat(col("period_year").cast("string"), col("period_quarter"))

    def stored(name: str, extra: Column | None = None) -> Column:
        present = company & col(name).isNotNull()
        return present if extra is None else present & extra

    # Check names, dictionary references and notes.
    rebuilt_note = "confirms the OMML formula reading; inputs are CSV-rounded"
    level_note = "file value is display-rounded; recomputed value keeps full precision"
    checks = [
        Check("tax expense = -tax_provision", "4 calc_tax_expense_quarterly",
              stored("tax_provision"), col(c.tax_expense) + col("tax_provision"), 1e-9),
        Check("tax rate = tax expense / pretax income", "4 calc_raw_tax_rate_quarterly",
              stored(c.tax_rate), col(c.tax_rate) - t,
              step + ratio(step * (1 + F.abs(t)), pretax_size), note="CSV rounds the tax rate to 0.01"),
        Check("NOPAT = EBIT x (1 - T)", "4 calc_nopat_quarterly", stored(c.nopat), col(c.nopat) - col(c.ebit) * keep,
              step + ratio(F.abs(c.ebit) * step * (1 + F.abs(t)), pretax_size) + step * F.abs(keep)),
        Check("IC raw = TCA - TCL + net PPE + goodwill", "4 calc_ic_raw",
              stored(c.ic_raw), col(c.ic_raw) - capital, 5 * step),
        Check("IC raw NaN pattern equals NaN of any input", "4 calc_ic_raw",
              company, passes=capital.isNull() == col(c.ic_raw).isNull()),
        Check("average IC = (IC[t-1] + IC[t]) / 2 (previous quarter in sequence)", "4 calc_average_ic_raw_quarterly",
              stored(c.avg_ic, col("prev_key_gap") == 1),
              col(c.avg_ic) - (col(c.ic_raw) + before(c.ic_raw)) / 2, 3 * step),
        Check("average IC is NaN after a sequence break", "4 calc_average_ic_raw_quarterly",
              company & broken, passes=col(c.avg_ic).isNull()),
        *[
            Check(f"{label} ROIC (file, rounded) = recomputed ROIC rounded to 0.01", f"4 {rounded}",
                  stored(rounded), col(rounded) - col(exact), step + 1e-9 + ratio(F.lit(2 * step), ic_size),
                  note=level_note)
            for label, rounded, exact in (
                ("pre-tax", c.roic_pretax_file, "roic_pretax_q"), ("post-tax", c.roic_posttax_file, "roic_posttax_q")
            )
        ],
        Check("ROIC change = ROIC[t] - ROIC[t-1]", "6.1 calc_roic_posttax_change_quarterly", stored(c.roic_change),
              col(c.roic_change) - (col("roic_posttax_q") - before("roic_posttax_q")),
              step6 + ratio(2 * step * level_size, ic_size)),
        Check("Shapley: C_EBIT + C_TAX + C_IC = change in ROIC", "6.2 / 11", stored(c.roic_change),
              col(c.c_ebit) + col(c.c_tax) + col(c.c_ic) - col(c.roic_change), 4 * step6),
        Check("decomposition residual = 0", "6.2 calc_roic_decomposition_residual",
              stored(c.residual), col(c.residual), step6),
        *[
            Check(f"Shapley C_{label} rebuilt from E, Q, I (weights 1/3, 1/6)", "6.2 calc_roic_*_contribution",
                  stored(name, valid), col(name) - rebuilt, 1e-5, note=rebuilt_note)
            for label, name, rebuilt in (("EBIT", c.c_ebit, by_e), ("TAX", c.c_tax, by_q), ("IC", c.c_ic, by_i))
        ],
        Check("debt = short-term + long-term debt incl. leases", "4 calc_debt_value_quarterly",
              stored(c.debt), col(c.debt) - debt_parts[0] - debt_parts[1], 3 * step),
        Check("D/E (file, rounded) = debt / stockholders equity", "4 calc_debt_to_equity_quarterly",
              stored(c.de_file), col(c.de_file) - col("debt_to_equity_q"),
              step + 1e-9 + ratio(2 * step * (1 + F.abs("debt_to_equity_q")), F.abs(c.stockholders_equity)),
              note="file value rounded to 0.01"),
        Check("economic_interpretation_valid == (quality_flag == VALID)", "6.7",
              company & is_true(valid) & col(c.econ_valid).isNotNull(),
              passes=col(c.econ_valid) == is_true(col(c.quality_flag) == "VALID")),
        Check("annualised post-tax ROIC = (1 + q)^4 - 1", "7.1 calc_roic_posttax_annualized_ic_raw",
              stored(c.roic_annualized), col(c.roic_annualized) - annualise(col("roic_posttax_q")),
              step6 + ratio(8 * step * (level_size * level_size * level_size), ic_size)),
        Check("Momentum_3Q = prod(1 + FQR[t-3..t-1]) - 1", "not in dictionary",
              stored(c.momentum, three_steps & col(c.forward_return).isNotNull()), col(c.momentum) - momentum, 1e-6,
              note="momentum is built only from returns realised before formation(t)"),
        Check("period_key = calendar quarter of (fiscal end - 2 months)", "1 alignment",
              company, passes=rule_key == col("period_key")),
        Check("KEY = period_key + '_' + symbol", "not in dictionary", F.lit(True),
              passes=col("KEY") == F.concat_ws("_", "period_key", "symbol"), note="all rows incl. benchmarks"),
        Check("period_year + period_quarter = period_key", "1", company, passes=year_quarter == col("period_key")),
    ]
    return summarise(rows, checks)


def full_precision_checks(data: DataFrame, c: Columns) -> DataFrame:
    """The same formulas on unrounded values with a relative tolerance (Q7)."""
    rows = data.filter(F.col(c.avg_ic).isNotNull() | F.col(c.ebit).isNotNull())
    rows = rows.withColumns({"q_ord": key_ordinal(F.col("period_key")), "__keep": 1 - F.col(c.tax_rate)})
    rows = add_lags(rows, {"q_ord": 1, c.ebit: 1, "__keep": 1, c.avg_ic: 1, c.roic_posttax_file: 1})
    col = F.col

    def before(name: str) -> Column:
        return F.col(lag_name(name, 1))

    adjacent = col("q_ord") - before("q_ord") == 1
    valid = (col(c.decomposition_status) == "VALID") & adjacent
    split = three_factor_split(
        before(c.ebit), col(c.ebit), before("__keep"), col("__keep"), before(c.avg_ic), col(c.avg_ic)
    )
    post, pre = ratio(col(c.nopat), col(c.avg_ic)), ratio(col(c.ebit), col(c.avg_ic))
    previous = before(c.roic_posttax_file)
    annual = annualise(col(c.roic_posttax_file))
    tag = "[full precision]"
    checks = [
        Check(f"{tag} {name} = Shapley formula (1/3, 1/6)", "6.2", valid & col(name).isNotNull(),
              col(name) - rebuilt, relative_tolerance(col(name)))
        for name, rebuilt in zip((c.c_ebit, c.c_tax, c.c_ic), split)
    ]
    checks += [
        Check(f"{tag} post-tax ROIC = NOPAT / avg IC", "4", col(c.roic_posttax_file).isNotNull(),
              col(c.roic_posttax_file) - post, relative_tolerance(post)),
        Check(f"{tag} pre-tax ROIC = EBIT / avg IC", "4", col(c.roic_pretax_file).isNotNull(),
              col(c.roic_pretax_file) - pre, relative_tolerance(col(c.roic_pretax_file))),
        Check(f"{tag} ROIC change = ROIC[t] - ROIC[t-1]", "6.1", col(c.roic_change).isNotNull() & adjacent,
              col(c.roic_change) - (col(c.roic_posttax_file) - previous), relative_tolerance(previous)),
        Check(f"{tag} C_EBIT + C_TAX + C_IC = change", "6.2", col(c.roic_change).isNotNull(),
              col(c.c_ebit) + col(c.c_tax) + col(c.c_ic) - col(c.roic_change), relative_tolerance(col(c.roic_change))),
        Check(f"{tag} annualised = (1 + q)^4 - 1", "7.1", col(c.roic_annualized).isNotNull(),
              col(c.roic_annualized) - annual, relative_tolerance(annual)),
    ]
    return summarise(rows, checks)
