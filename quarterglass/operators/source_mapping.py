"""A second, larger source mapped onto the panel schema.

Source columns are year-to-date for cash flows, carry the natural sign for
taxes and interest, and identify firms by ``gvkey`` and full ticker ``tic``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterglass.functions.nulls import is_true
from quarterglass.functions.quarters import date_ordinal, ordinal_key, ordinal_quarter, ordinal_year
from quarterglass.operators.sequence import by_entity
from quarterglass.settings import SequenceRule

# Target column -> source column.
RENAMES = {
    "total_current_assets": "actq",
    "cash_and_cash_equivalents": "cheq",
    "short_term_investments": "ivstq",
    "total_current_liabilities": "lctq",
    "short_term_debt": "dlcq",
    "long_term_debt_and_capital_lease": "dlttq",
    "goodwill": "gdwlq",
    "net_ppe": "ppentq",
    "total_assets": "lseq",
    "equity": "teqq",
    "total_stockholders_equity": "seqq",
    "ebit": "oiadpq",
    "pretax_income": "piq",
    "market_cap": "mkvaltq",
    "company": "conm",
    "fiscal_period_end_date": "datadate",
}
# Target columns the source cannot fill, kept as typed NULLs.
UNFILLED = {
    "Future_Quarterly_Return": "double",
    "Momentum_3Q": "double",
    "sector": "string",
    "valuations__per_share_data__month_end_stock_price": "double",
    "valuations__per_share_data__shares_outstanding": "double",
    "intangible_assets": "double",
    "industry": "string",
    "filing_date": "date",
    "valuations__ratios__debt_to_equity": "double",
    "valuations__valuation_ratios__enterprise_value_to_fcf": "double",
}


def map_schema(source: DataFrame) -> DataFrame:
    """Renames, sign flips, proxy column and typed NULLs in one projection."""
    kept = [n for n in source.columns if n not in RENAMES.values() and n not in ("txtq", "xintq")]
    return source.select(
        *kept,
        *[F.col(old).alias(new) for new, old in RENAMES.items()],
        (-F.col("txtq")).alias("tax_provision"),
        (-F.col("xintq")).alias("interest_expense"),
        F.col("dlcq").alias("short_term_debt_and_capital_lease"),
        F.when(F.col("dlcq").isNotNull(), "PROXY_FROM_DLCQ").alias("short_term_debt_source"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in UNFILLED.items()],
    )


def add_liabilities(mapped: DataFrame) -> DataFrame:
    """Liabilities from total equity, else from stockholders' equity with a flag."""
    base = F.coalesce("equity", "total_stockholders_equity")
    return mapped.withColumns(
        {
            "total_liabilities": F.col("total_assets") - base,
            "flag_total_liabilities_from_seqq": F.col("equity").isNull() & F.col("total_stockholders_equity").isNotNull(),
        }
    )


def add_keys(mapped: DataFrame, shift_months: int = 2) -> DataFrame:
    """Quarter labels, KEY from the full ticker, suffix-free symbol."""
    ordinal = date_ordinal(F.add_months("fiscal_period_end_date", -shift_months))
    keyed = mapped.withColumn("q_ord", ordinal)
    q = F.col("q_ord")
    return keyed.withColumns(
        {
            "period_key": ordinal_key(q),
            "period_year": ordinal_year(q),
            "period_quarter": F.concat(F.lit("Q"), ordinal_quarter(q).cast("string")),
            "KEY": F.concat_ws("_", ordinal_key(q), F.col("tic")),
            "symbol": F.regexp_replace("tic", r"\..*$", ""),
        }
    )


def link_filings(keyed: DataFrame, rule: SequenceRule) -> DataFrame:
    """Gaps and links per gvkey; needs one row per (gvkey, quarter)."""
    w = by_entity("gvkey")
    gaps = keyed.withColumns(
        {
            "prev_key_gap": F.col("q_ord") - F.lag("q_ord").over(w),
            "prev_day_gap": F.datediff("fiscal_period_end_date", F.lag("fiscal_period_end_date").over(w)),
        }
    )
    linked = (F.col("prev_key_gap") == rule.key_gap) & F.col("prev_day_gap").between(rule.min_days, rule.max_days)
    return gaps.withColumn("is_consecutive_prev", is_true(linked))


def fiscal_q1_vote(linked: DataFrame, ytd: str = "capxy") -> DataFrame:
    """Month of the first fiscal quarter per firm by majority of year-to-date resets, with purity.

    Ties go to the earlier month.
    """
    reset = F.col("is_consecutive_prev") & (F.col(ytd) < F.lag(ytd).over(by_entity("gvkey")))
    # the reset flag is computed before the filter so that lag() sees every row
    votes = linked.withColumn("__reset", is_true(reset)).filter("__reset")
    votes = votes.groupBy("gvkey", F.month("fiscal_period_end_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("month", F.struct(F.col("n"), -F.col("month")))
    return votes.groupBy("gvkey").agg(
        best.alias("fiscal_q1_month"), (F.max("n") / F.sum("n")).alias("purity"), F.sum("n").alias("n_resets")
    )


def ytd_to_quarter(linked: DataFrame, votes: DataFrame, columns: list[str]) -> DataFrame:
    """Quarterly flow from year-to-date: the value itself in the first fiscal quarter, else the step.

    NULL when the first quarter is unknown or the previous quarter is missing.
    """
    w = by_entity("gvkey")
    steps = linked.withColumns({f"__{c}": F.col(c) - F.lag(c).over(w) for c in columns})
    voted = steps.join(votes.select("gvkey", "fiscal_q1_month"), "gvkey", "left")
    first = F.month("fiscal_period_end_date") == F.col("fiscal_q1_month")
    known = F.col("fiscal_q1_month").isNotNull()
    flows = {
        f"{c}_quarterly": F.when(known & first, F.col(c)).when(known & F.col("is_consecutive_prev"), F.col(f"__{c}"))
        for c in columns
    }
    return voted.withColumns(flows).drop(*[f"__{c}" for c in columns])


def add_quality_flags(keyed: DataFrame, votes: DataFrame) -> DataFrame:
    """Seven row flags; nothing is removed.

    Both group facts are map-side aggregates joined back, so a hot ticker or
    firm never has to fit a window group.
    """
    periods = keyed.groupBy("gvkey", "period_key").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    tickers = keyed.groupBy("symbol").agg(F.min("gvkey").alias("__a"), F.max("gvkey").alias("__b"))
    tickers = tickers.filter("__a <> __b").select("symbol")

    def marked(rows: DataFrame, found: DataFrame, on: list[str], name: str) -> DataFrame:
        right = found.select(*[F.col(c).alias(f"__{c}") for c in on], F.lit(True).alias("__hit"))
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in on])
        out = rows.join(right, same, "left").withColumn(name, F.col("__hit").isNotNull())
        return out.drop("__hit", *[f"__{c}" for c in on])

    out = marked(keyed, periods, ["gvkey", "period_key"], "flag_duplicate_period")
    out = marked(out, tickers, ["symbol"], "flag_ticker_collision")
    out = marked(out, votes.select("gvkey"), ["gvkey"], "__q1_known")

    def missing(name: str) -> Column:
        return F.col(name).isNull()

    return out.withColumns(
        {
            "flag_total_liabilities_from_seqq": missing("equity") & ~missing("total_stockholders_equity"),
            "flag_fcf_fiscal_q1_unresolved": ~F.col("__q1_known"),
            "flag_std_proxy": ~missing("short_term_debt_and_capital_lease"),
            "flag_delisted": is_true(F.col("costat") == "I"),
            "flag_missing_market_cap": missing("market_cap"),
        }
    ).drop("__q1_known")
