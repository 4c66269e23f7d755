"""From raw statements to capital, profit, return, its drivers and the cost of capital."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterglass.functions.measures import annualise, three_factor_split, total, two_factor_split
from quarterglass.functions.nulls import is_true, ratio
from quarterglass.operators.sequence import add_lags, drop_lags, lag_name, unbroken
from quarterglass.operators.signals import window_sum
from quarterglass.settings import Columns

C = Columns()


def _before(name: str, k: int = 1) -> Column:
    return F.col(lag_name(name, k))


def add_capital_and_profit(panel: DataFrame) -> DataFrame:
    """Tax rate, NOPAT, invested capital, its average, both returns, debt and enterprise value.

    Needs q_ord and prev_key_gap; averages exist only right after the previous quarter.
    """
    col = F.col
    rate = ratio(col(C.tax_expense), col(C.pretax_income))
    capital = col("total_current_assets") - col("total_current_liabilities") + col("net_ppe") + col("goodwill")
    debt = col("short_term_debt_and_capital_lease") + col("long_term_debt_and_capital_lease")
    first = panel.withColumn(C.tax_expense, -col("tax_provision")).withColumns(
        {C.tax_rate: rate, C.ic_raw: capital, C.debt: debt}
    )
    second = add_lags(first.withColumn(C.nopat, col(C.ebit) * (1 - col(C.tax_rate))), {C.ic_raw: 1})
    average = F.when(col("prev_key_gap") == 1, (_before(C.ic_raw) + col(C.ic_raw)) / 2)
    out = second.withColumns(
        {
            C.avg_ic: average,
            C.de_file: ratio(col(C.debt), col(C.stockholders_equity)),
            "calc_enterprise_value_quarterly": col("market_cap")
            + col(C.debt)
            - col("cash_and_cash_equivalents")
            - col("short_term_investments"),
        }
    )
    out = drop_lags(out).withColumns(
        {C.roic_pretax_file: ratio(col(C.ebit), col(C.avg_ic)), C.roic_posttax_file: ratio(col(C.nopat), col(C.avg_ic))}
    )
    # a loss of the whole capital cannot be compounded
    return out.withColumns(
        {
            "calc_roic_pretax_annualized_ic_raw": F.when(col(C.roic_pretax_file) > -1, annualise(col(C.roic_pretax_file))),
            C.roic_annualized: F.when(col(C.roic_posttax_file) > -1, annualise(col(C.roic_posttax_file))),
        }
    )


def add_nopat_drivers(panel: DataFrame) -> DataFrame:
    """Change in NOPAT split over EBIT and tax."""
    keep = panel.withColumn("__keep", 1 - F.col(C.tax_rate))
    wide = add_lags(keep, {C.ebit: 1, C.nopat: 1, "__keep": 1})
    near = F.col("prev_key_gap") == 1
    by_e, by_q = two_factor_split(_before(C.ebit), F.col(C.ebit), _before("__keep"), F.col("__keep"))
    out = wide.withColumns(
        {
            "calc_nopat_change_quarterly": F.when(near, F.col(C.nopat) - _before(C.nopat)),
            "calc_nopat_ebit_contribution": F.when(near, by_e),
            "calc_nopat_tax_contribution": F.when(near, by_q),
        }
    )
    parts = F.col("calc_nopat_ebit_contribution") + F.col("calc_nopat_tax_contribution")
    out = out.withColumn("calc_nopat_decomposition_residual", F.col("calc_nopat_change_quarterly") - parts)
    return drop_lags(out).drop("__keep")


def add_roic_drivers(panel: DataFrame) -> DataFrame:
    """Status, change, three contributions, shares, offset ratio and dominant driver."""
    keep = panel.withColumn("__keep", 1 - F.col(C.tax_rate))
    wide = add_lags(keep, {C.ebit: 1, "__keep": 1, C.avg_ic: 1, C.roic_posttax_file: 1})
    now, then = F.col(C.roic_posttax_file), _before(C.roic_posttax_file)
    # Status texts.
    status = (
        F.when(~F.col("is_consecutive_prev"), "UNCLASSIFIED_NONCONSECUTIVE")
        .when(now.isNull() | then.isNull(), "UNCLASSIFIED_MISSING_INPUT")
        .otherwise("VALID")
    )
    split = three_factor_split(
        _before(C.ebit), F.col(C.ebit), _before("__keep"), F.col("__keep"), _before(C.avg_ic), F.col(C.avg_ic)
    )
    valid = F.col(C.decomposition_status) == "VALID"
    out = wide.withColumn(C.decomposition_status, status)
    changes = {C.roic_change: F.when(valid, now - then)}
    changes |= {name: F.when(valid, part) for name, part in zip((C.c_ebit, C.c_tax, C.c_ic), split)}
    in_range = F.col(C.tax_rate).between(0.0, 1.0)
    # Quality texts.
    quality = (
        F.when(~valid, F.lit(None).cast("string"))
        .when((F.col(C.avg_ic) <= 0) | (_before(C.avg_ic) <= 0), "NEGATIVE_IC_MECHANICAL_ONLY")
        .when(~in_range, "TAX_RATE_OUT_OF_RANGE")
        .otherwise("VALID")
    )
    out = out.withColumns(changes | {C.quality_flag: quality})
    pieces = [F.col(n) for n in (C.c_ebit, C.c_tax, C.c_ic)]
    magnitude = total([F.abs(p) for p in pieces])
    out = out.withColumns(
        {
            C.residual: F.col(C.roic_change) - total(pieces),
            C.econ_valid: F.when(valid, F.col(C.quality_flag) == "VALID"),
            "calc_roic_total_absolute_contribution": magnitude,
            "calc_roic_offset_ratio": 1 - ratio(F.abs(total(pieces)), magnitude),
        }
        | {f"calc_roic_{n}_absolute_share": ratio(F.abs(p), magnitude) for n, p in zip(("ebit", "tax", "ic"), pieces)}
    )
    return drop_lags(out.withColumn("calc_roic_dominant_driver", _dominant_driver())).drop("__keep")


def _dominant_driver(balance: float = 0.05) -> Column:
    """Driver with the largest absolute share; BALANCED when the top two are within ``balance``."""
    shares = {n.upper(): F.col(f"calc_roic_{n}_absolute_share") for n in ("ebit", "tax", "ic")}
    e, t, i = shares.values()
    top = F.greatest(e, t, i)
    second = F.greatest(F.least(e, t), F.least(F.greatest(e, t), i))
    magnitude = F.col("calc_roic_total_absolute_contribution")
    named = F.when(magnitude.isNull(), F.lit(None).cast("string")).when(magnitude == 0, "NONE")
    named = named.when(top - second <= balance, "BALANCED")
    for name, share in shares.items():
        named = named.when(share == top, name)
    return named


def _dominant_effect(balance: float = 0.05) -> Column:
    """Effect of the dominant driver. Drivers whose shares are within ``balance`` of the largest share dominate together:
    theirs is the effect that they agree on, and NULL where they pull apart."""
    shares = {n: F.col(f"calc_roic_{n}_absolute_share") for n in ("ebit", "tax", "ic")}
    top = F.greatest(*shares.values())
    leading = [F.when(top - share <= balance, F.col(f"calc_roic_{n}_effect")) for n, share in shares.items()]
    agreed = F.array_distinct(F.array_compact(F.array(*leading)))
    by_share = F.when(F.size(agreed) == 1, F.get(agreed, F.lit(0)))
    return F.when(F.col("calc_roic_dominant_driver") == "NONE", "zero").otherwise(by_share)


def tax_rate_flag(rate: Column, valid: Column) -> Column:
    """Whether the tax rate of a valid row lies between 0 and 1, in the words of the quality flag; NULL without a rate."""
    return F.when(valid & rate.isNotNull(), F.when(rate.between(0, 1), "VALID").otherwise("TAX_RATE_OUT_OF_RANGE"))


def _three_way(value: Column, tolerance: Column | float, up: str, down: str, flat: str) -> Column:
    tolerance = F.lit(tolerance) if isinstance(tolerance, float) else tolerance
    return F.when(value > tolerance, up).when(value < -tolerance, down).when(value.isNotNull(), flat)


def add_movement_labels(panel: DataFrame, tolerance: Column | float = 0.0) -> DataFrame:
    """Directions, effects, sign regimes and driver counts of valid rows.

    ``tolerance`` is the caller's materiality threshold; none is built in.
    """
    wide = add_lags(panel, {C.ebit: 1, C.tax_rate: 1, C.avg_ic: 1, C.nopat: 1})
    valid = F.col(C.decomposition_status) == "VALID"

    def moved(name: str) -> Column:
        return F.when(valid, _three_way(F.col(name) - _before(name), tolerance, "up", "down", "flat"))

    def effect(name: str) -> Column:
        return F.when(valid, _three_way(F.col(name), tolerance, "pos", "neg", "zero"))

    def regime(name: str) -> Column:
        sign = [_three_way(v, 0.0, "pos", "neg", "zero") for v in (_before(name), F.col(name))]
        return F.when(valid, F.concat(sign[0], F.lit("_to_"), sign[1]))

    parts = {"ebit": C.c_ebit, "tax": C.c_tax, "ic": C.c_ic}
    out = wide.withColumns(
        {
            "calc_roic_posttax_change_direction": F.when(
                valid, _three_way(F.col(C.roic_change), tolerance, "up", "down", "flat")
            ),
            "calc_ebit_movement": moved(C.ebit),
            "calc_tax_rate_movement": moved(C.tax_rate),
            "calc_ic_movement": moved(C.avg_ic),
            "calc_ebit_sign_regime": regime(C.ebit),
            "calc_nopat_sign_regime": regime(C.nopat),
        }
        | {f"calc_roic_{n}_effect": effect(col) for n, col in parts.items()}
    )
    effects = [F.col(f"calc_roic_{n}_effect") for n in parts]

    def counted(label: str) -> Column:
        return F.when(valid, total([(e == label).cast("int") for e in effects]))

    def joined(prefix: dict[str, str]) -> Column:
        cells = [F.concat(F.lit(f"{short}_"), F.col(name)) for short, name in prefix.items()]
        return F.when(valid, F.concat_ws("__", *cells))

    out = out.withColumns(
        {
            "calc_roic_positive_driver_count": counted("pos"),
            "calc_roic_negative_driver_count": counted("neg"),
            "calc_roic_neutral_driver_count": counted("zero"),
            "calc_roic_effect_combination": joined({n: f"calc_roic_{n}_effect" for n in parts}),
            "calc_raw_movement_combination": joined(
                {"ebit": "calc_ebit_movement", "tax": "calc_tax_rate_movement", "ic": "calc_ic_movement"}
            ),
        }
    )
    pos, neg = F.col("calc_roic_positive_driver_count"), F.col("calc_roic_negative_driver_count")
    out = out.withColumns(
        {
            "calc_roic_active_driver_count": pos + neg,
            "calc_roic_has_opposing_effects": (pos > 0) & (neg > 0),
            "calc_roic_dominant_driver_effect": F.when(valid, _dominant_effect()),
            "calc_tax_rate_quality_flag": tax_rate_flag(F.col(C.tax_rate), valid),
        }
    )
    return drop_lags(out)


def add_nopat_labels(panel: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Effect labels of the two NOPAT contributions and their combination."""
    effects = {
        f"calc_nopat_{n}_effect": _three_way(F.col(f"calc_nopat_{n}_contribution"), tolerance, "pos", "neg", "zero")
        for n in ("ebit", "tax")
    }
    cells = [F.concat(F.lit(f"{n}_"), F.col(f"calc_nopat_{n}_effect")) for n in ("ebit", "tax")]
    both = reduce(lambda a, b: a & b, [F.col(f"calc_nopat_{n}_effect").isNotNull() for n in ("ebit", "tax")])
    return panel.withColumns(effects).withColumn(
        "calc_nopat_effect_combination", F.when(both, F.concat_ws("__", *cells))
    )


def combo_names() -> dict[str, list[str]]:
    """Combination column -> names of its indicator columns, 63 in all."""
    signs, moves = ("pos", "neg", "zero"), ("up", "down", "flat")

    def names(prefix: str, drivers: tuple[str, ...], levels: tuple[str, ...]) -> list[str]:
        tails = ["__".join(f"{d}_{v}" for d, v in zip(drivers, combo)) for combo in product(levels, repeat=len(drivers))]
        return [f"calc_{prefix}_combo__{tail}" for tail in tails]

    return {
        "calc_nopat_effect_combination": names("nopat", ("ebit", "tax"), signs),
        "calc_raw_movement_combination": names("raw", ("ebit", "tax", "ic"), moves),
        "calc_roic_effect_combination": names("roic", ("ebit", "tax", "ic"), signs),
    }


def add_combo_dummies(panel: DataFrame) -> DataFrame:
    """63 indicator columns: one per combination, all zero on unclassified rows."""
    dummies = {
        name: is_true(F.col(source) == name.split("_combo__")[1]).cast("byte")
        for source, names in combo_names().items()
        for name in names
    }
    return panel.withColumns(dummies)


@dataclass(frozen=True)
class CapitalCost:
    """Market assumptions of the cost of equity (fixed defaults)."""

    risk_free: float = 0.0425
    equity_premium: float = 0.0300
    window: int = 4


def add_ttm(panel: DataFrame, column: str, name: str, window: int = 4) -> DataFrame:
    """Sum over the last ``window`` linked quarters, NULL if one is missing."""
    wide = add_lags(panel, {column: window - 1, "is_consecutive_prev": window - 1})
    return drop_lags(wide.withColumn(name, F.when(unbroken(window), window_sum(column, window))))


def add_wacc(panel: DataFrame, cost: CapitalCost = CapitalCost()) -> DataFrame:
    """Cost of capital and value creation (B13). Annual rates; quarterly by the fourth root."""
    w = cost.window
    prepared = panel.withColumn("__interest", -F.col("interest_expense"))
    names = ("__interest", C.tax_expense, C.pretax_income)
    wide = add_lags(prepared, {n: w - 1 for n in names} | {"is_consecutive_prev": w - 1, C.debt: 1})
    whole = unbroken(w)
    sums = {n: F.when(whole, window_sum(n, w)) for n in names}
    average_debt = F.when(F.col("is_consecutive_prev"), (_before(C.debt) + F.col(C.debt)) / 2)
    rate = ratio(sums[C.tax_expense], sums[C.pretax_income])
    capital = F.col("market_cap") + F.col(C.debt)
    first = wide.withColumns(
        {
            "calc_interest_expense_ttm": sums["__interest"],
            "calc_wacc_average_debt": average_debt,
            "calc_wacc_tax_rate": F.when(rate.isNotNull(), F.greatest(F.lit(0.0), rate)),
            "calc_wacc_risk_free_rate": F.lit(cost.risk_free),
            "calc_wacc_equity_risk_premium": F.lit(cost.equity_premium),
            "calc_wacc_cost_of_equity": F.lit(cost.risk_free) + F.lit(cost.equity_premium),
            "calc_wacc_equity_value": F.col("market_cap"),
            "calc_wacc_total_capital": capital,
            "calc_wacc_equity_weight": ratio(F.col("market_cap"), capital),
            "calc_wacc_debt_weight": ratio(F.col(C.debt), capital),
        }
    )
    second = first.withColumn(
        "calc_wacc_cost_of_debt", ratio(F.col("calc_interest_expense_ttm"), F.col("calc_wacc_average_debt"))
    )
    after_tax = F.col("calc_wacc_cost_of_debt") * (1 - F.col("calc_wacc_tax_rate"))
    third = second.withColumn("calc_wacc_after_tax_cost_of_debt", after_tax)
    annual = F.col("calc_wacc_equity_weight") * F.col("calc_wacc_cost_of_equity") + F.col(
        "calc_wacc_debt_weight"
    ) * F.col("calc_wacc_after_tax_cost_of_debt")
    fourth = third.withColumn("calc_wacc_annual", annual)
    growth = 1 + F.col("calc_wacc_annual")
    fifth = fourth.withColumn("calc_wacc_quarterly", F.when(growth >= 0, F.sqrt(F.sqrt(growth)) - 1))
    spread = F.col(C.roic_annualized) - F.col("calc_wacc_annual")
    # The classes of the flag.
    flag = (
        F.when(~is_true(whole), "INSUFFICIENT_HISTORY")
        .when(F.col("market_cap").isNull(), "MISSING_MARKET_CAP")
        .when(F.col(C.debt).isNull(), "MISSING_DEBT")
        .when((F.col(C.debt) > 0) & (F.col("calc_interest_expense_ttm") == 0), "DEBT_WITHOUT_INTEREST")
        .when(F.col("calc_wacc_annual").isNotNull(), "VALID")
    )
    out = fifth.withColumns(
        {
            "calc_wacc_quality_flag": flag,
            "calc_wacc_inputs_complete": F.col("calc_wacc_annual").isNotNull(),
            "calc_roic_minus_wacc_annualized": spread,
            "calc_roic_minus_wacc_quarterly": F.col(C.roic_posttax_file) - F.col("calc_wacc_quarterly"),
            "calc_creates_value": spread > 0,
        }
    )
    return drop_lags(out).drop("__interest")


@dataclass(frozen=True)
class Rule:
    """A row rule: rows where ``applies`` is true are tested with ``holds``."""

    name: str
    applies: Column
    holds: Column
    note: str = ""


def jump_rule(column: str) -> Rule:
    """No change above 50 % and above 1,000 against the previous row."""
    then = _before(column)
    change = F.abs(F.col(column) - then)
    # Thresholds of the jump rule.
    calm = (change <= 1000.0) | (change <= F.abs(then) * 0.5)
    note = "Flags changes above 50% and 1,000."
    return Rule(f"No unexplained jump in {column}", change.isNotNull(), calm, note)


def summarise_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Tested, failed, share of passes in percent and skipped rows per rule, in one pass."""
    cells = []
    for i, rule in enumerate(rules):
        applies = is_true(rule.applies)
        cells += [applies.alias(f"t{i}"), (applies & ~is_true(rule.holds)).alias(f"f{i}")]
    outcome = rows.select(*cells)
    lines = []
    for i, rule in enumerate(rules):
        tested, failed = F.count_if(f"t{i}"), F.count_if(f"f{i}")
        percent = F.try_divide((tested - failed) * 100, tested)
        lines.append(
            F.struct(
                F.lit(i + 1).alias("line"),
                F.lit(rule.name).alias("check"),
                tested.alias("n_tested"),
                failed.alias("n_failed"),
                (F.floor(percent * 10 + 0.5) / 10).alias("pct_ok"),
                F.count_if(~F.col(f"t{i}")).alias("n_skipped"),
                F.lit(rule.note).alias("note"),
            )
        )
    table = outcome.agg(F.array(*lines).alias("r")).selectExpr("inline(r)")
    return table.orderBy("line").drop("line")


def rule_battery(panel: DataFrame) -> DataFrame:
    """The 26 upstream quality rules (B19); ``panel`` has the cost of capital and the trailing cash flow of B9 and B13."""
    jumps = ("goodwill", "intangible_assets", "net_ppe", "short_term_investments")
    rows = add_lags(panel, {n: 1 for n in jumps} | {"free_cash_flow": 3, "is_consecutive_prev": 3})
    rows = rows.withColumn("__same_key", F.count(F.lit(1)).over(Window.partitionBy("symbol", "period_key")))
    trailing = F.when(unbroken(4), window_sum("free_cash_flow", 4))
    col = F.col

    def both(*names: str) -> Column:
        return reduce(lambda a, b: a & b, [col(n).isNotNull() for n in names])

    def near(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
        return F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(b)) * tolerance

    def one_hot(prefix: str, source: str) -> Column:
        hits = total([is_true(col(source) == n.split("_combo__")[1]).cast("int") for n in combo_names()[source]])
        return hits == F.when(col(source).isNotNull(), 1).otherwise(0)

    cash = col("cash_and_cash_equivalents") + col("short_term_investments")
    ev = col("market_cap") + col(C.debt) - cash
    parts = col(C.c_ebit) + col(C.c_tax) + col(C.c_ic)
    shares = [f"calc_roic_{n}_absolute_share" for n in ("ebit", "tax", "ic")]
    weights = ("calc_wacc_equity_weight", "calc_wacc_debt_weight")
    after_tax = col("calc_wacc_cost_of_debt") * (1 - col("calc_wacc_tax_rate"))
    priced = col("calc_wacc_equity_weight") * col("calc_wacc_cost_of_equity") + col("calc_wacc_debt_weight") * after_tax
    quarterly = 1 + col("calc_wacc_quarterly")
    squared = quarterly * quarterly
    every = F.lit(True)
    # Rule names and notes.
    rules = [
        Rule("Current assets cover cash and short-term investments",
             col("total_current_assets").isNotNull() & cash.isNotNull(), col("total_current_assets") >= cash),
        *[jump_rule(n) for n in jumps],
        Rule("Consecutive reporting periods", col("prev_key_gap").isNotNull(), col("is_consecutive_prev"),
             "Expected a gap of 60-130 days."),
        Rule("period_key is unique within ticker", col("period_key").isNotNull(), col("__same_key") == 1),
        Rule("Market capitalization is positive", col("market_cap").isNotNull(), col("market_cap") > 0),
        Rule("Equity matches total assets less total liabilities",
             both("equity", "total_assets", "total_liabilities"),
             near(col("equity"), col("total_assets") - col("total_liabilities"))),
        Rule("Calculated debt matches short-term plus long-term debt", col(C.debt).isNotNull(),
             near(col(C.debt), col("short_term_debt_and_capital_lease") + col("long_term_debt_and_capital_lease"))),
        Rule("Calculated debt is non-negative", col(C.debt).isNotNull(), col(C.debt) >= 0),
        Rule("Debt-to-equity ratio matches debt and stockholders equity", col(C.de_file).isNotNull(),
             near(col(C.de_file), ratio(col(C.debt), col(C.stockholders_equity)))),
        Rule("Enterprise value matches its displayed inputs", col("calc_enterprise_value_quarterly").isNotNull(),
             near(col("calc_enterprise_value_quarterly"), ev),
             "EV includes market capitalization plus debt, less cash and short-term investments."),
        Rule("Trailing-four-quarter FCF matches four consecutive quarters", col("calc_free_cash_flow_ttm").isNotNull(),
             near(col("calc_free_cash_flow_ttm"), trailing)),
        Rule("Quarter-end EV/FCF matches EV divided by trailing FCF", col("calc_ev_to_fcf_quarterly").isNotNull(),
             near(col("calc_ev_to_fcf_quarterly"), ratio(col("calc_enterprise_value_quarterly"), trailing))),
        Rule("NOPAT Shapley contributions sum to the total change", col("calc_nopat_change_quarterly").isNotNull(),
             near(col("calc_nopat_ebit_contribution") + col("calc_nopat_tax_contribution"), col("calc_nopat_change_quarterly")),
             "Order-independent decomposition is exactly efficient."),
        Rule("Post-tax ROIC Shapley contributions sum to the total change", col(C.roic_change).isNotNull(),
             near(parts, col(C.roic_change)), "Order-independent decomposition is exactly efficient."),
        *[
            Rule(f"{label} combination selects exactly one column", every, one_hot(label, source),
                 "Classified rows set one indicator; unclassified rows set none.")
            for label, source in (
                ("NOPAT effect", "calc_nopat_effect_combination"),
                ("Raw movement", "calc_raw_movement_combination"),
                ("ROIC effect", "calc_roic_effect_combination"),
            )
        ],
        Rule("ROIC absolute contribution shares sum to one", both(*shares), near(total([col(s) for s in shares]), F.lit(1.0))),
        Rule("ROIC offset ratio lies between zero and one", col("calc_roic_offset_ratio").isNotNull(),
             col("calc_roic_offset_ratio").between(-1e-9, 1 + 1e-9),
             "Guaranteed by the triangle inequality on the contributions."),
        Rule("WACC capital weights sum to one", both(*weights), near(total([col(n) for n in weights]), F.lit(1.0))),
        Rule("WACC matches its weights and component costs", col("calc_wacc_annual").isNotNull(),
             near(col("calc_wacc_annual"), priced), "E/(D+E) x Re + D/(D+E) x Rd x (1-T)."),
        Rule("Quarterly WACC compounds back to the annual WACC", both("calc_wacc_quarterly", "calc_wacc_annual"),
             near(squared * squared - 1, col("calc_wacc_annual"))),
        Rule("Value-creation verdict is the same annually and quarterly",
             both("calc_roic_minus_wacc_annualized", "calc_roic_minus_wacc_quarterly"),
             (col("calc_roic_minus_wacc_annualized") > 0) == (col("calc_roic_minus_wacc_quarterly") > 0),
             "Annualisation is monotonic, so the sign of the spread is invariant."),
    ]
    return summarise_rules(rows, rules)
