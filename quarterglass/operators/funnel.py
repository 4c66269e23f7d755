"""Sample funnels, structure counts and reasons for missing signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterglass.functions.nulls import is_true
from quarterglass.settings import PanelSettings

# Funnel steps as (label, condition).
FLOW_STEPS = (
    ("1 raw rows (all symbols)", "true"),
    ("1a benchmark ETF rows (SPY/QQQ)", "is_benchmark"),
    ("1b company rows", "NOT is_benchmark"),
    ("2 population: company rows that are index members in period_key", "in_population"),
    ("2a population with pre-tax ROIC level", "in_population AND has_roic_pretax_level"),
    ("2b population with post-tax ROIC level", "in_population AND has_roic_posttax_level"),
    ("2c population with ROIC 4q trend", "in_population AND has_roic_trend"),
    ("2d population with all three signals (common sort sample)", "in_population AND has_level_and_trend_signals"),
    ("2e population with all three contribution trends", "in_population AND has_all_contribution_trends"),
    ("2f population rows flagged fiscal end < 2 months before formation (kept)", "in_population AND signal_lag_below_min"),
    ("3 evaluation: population with realised forward return", "in_evaluation_sample"),
    ("3d evaluation within common sort sample", "in_evaluation_sample AND has_level_and_trend_signals"),
    ("3e evaluation with all contribution trends", "in_evaluation_sample AND has_all_contribution_trends"),
)

# Why a population row has no post-tax ratio, in order of precedence.
MISSING_REASONS = (
    "1 current assets or current liabilities missing (IC undefined)",
    "2 goodwill missing, other IC inputs present",
    "3 net PPE missing",
    "4 IC present but previous quarter missing / not consecutive",
    "5 NOPAT missing (EBIT, tax or pretax income)",
    "6 average IC equals zero",
    "7 other",
)


def sample_flow(panel: DataFrame) -> DataFrame:
    """Rows, firms, quarters and first/last quarter per funnel step (A1).

    One pass with two grouping sets, per symbol and per quarter, combined on
    the map side; 26 distinct aggregates would copy each row 26 times.
    """
    masks = {f"m{i}": F.expr(condition) for i, (_, condition) in enumerate(FLOW_STEPS)}
    flagged = panel.select("symbol", "period_key", *[m.alias(n) for n, m in masks.items()])
    grouped = flagged.groupingSets([["symbol"], ["period_key"]], "symbol", "period_key")
    # grouping_id: 1 for the rows per symbol, 2 for the rows per quarter
    hits = grouped.agg(*[F.count_if(n).alias(n) for n in masks], F.grouping_id().alias("gid"))
    lines = hits.unpivot(["symbol", "period_key", "gid"], list(masks), "step_id", "n").filter("n > 0")
    counted = lines.groupBy("step_id").agg(
        F.sum(F.when(F.col("gid") == 2, F.col("n"))).alias("rows"),
        F.count("symbol").alias("firms"),
        F.count("period_key").alias("quarters"),
        F.min("period_key").alias("first_quarter"),
        F.max("period_key").alias("last_quarter"),
    )
    labels = F.create_map(*[F.lit(x) for i, (label, _) in enumerate(FLOW_STEPS) for x in (f"m{i}", label)])
    steps = panel.sparkSession.range(len(FLOW_STEPS)).select(F.concat(F.lit("m"), F.col("id")).alias("step_id"))
    out = steps.join(counted, "step_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "firms", "quarters")]
    return out.select(labels[F.col("step_id")].alias("step"), *counts, "first_quarter", "last_quarter")


def sample_flow_by_quarter(panel: DataFrame) -> DataFrame:
    """Eleven conditional counts per quarter in one aggregation (A2)."""
    pop, ev = F.col("in_population"), F.col("in_evaluation_sample")
    counts = {
        "population": pop,
        "pop_with_roic_pretax": pop & F.col("has_roic_pretax_level"),
        "pop_with_roic_posttax": pop & F.col("has_roic_posttax_level"),
        "pop_with_roic_trend": pop & F.col("has_roic_trend"),
        "pop_common_sort_sample": pop & F.col("has_level_and_trend_signals"),
        "pop_all_contribution_trends": pop & F.col("has_all_contribution_trends"),
        "pop_signal_lag_below_min": pop & F.col("signal_lag_below_min"),
        "evaluation_rows": ev,
        "evaluation_common_sort_sample": ev & F.col("has_level_and_trend_signals"),
        "return_window_unrealized_rows": F.col("fwd_return_window_unrealized"),
    }
    grouped = panel.filter(~F.col("is_benchmark")).groupBy("period_key")
    return grouped.agg(F.count(F.lit(1)).alias("company_rows"), *[F.count_if(m).alias(n) for n, m in counts.items()])


def firms_per_quarter(panel: DataFrame) -> DataFrame:
    """Rows, distinct firms, members and non-members per quarter (A3)."""
    grouped = panel.filter(~F.col("is_benchmark")).groupBy("period_key")
    return grouped.agg(
        F.count(F.lit(1)).alias("company_rows"),
        F.count_distinct("symbol").alias("distinct_firms"),
        F.count_if("in_population").alias("population_firms"),
        F.count_if(~F.col("in_population")).alias("rows_not_in_index"),
    )


def quarters_per_firm(panel: DataFrame) -> DataFrame:
    """Span, breaks and gaps per firm (A4)."""

    def first_known(name: str) -> Column:
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("q_ord")))

    grouped = panel.filter(~F.col("is_benchmark")).groupBy("symbol")
    out = grouped.agg(
        first_known("company").alias("company"),
        first_known("sector").alias("sector"),
        F.count(F.lit(1)).alias("n_quarters"),
        F.min("period_key").alias("first_period"),
        F.max("period_key").alias("last_period"),
        (F.max("q_ord") - F.min("q_ord") + 1).alias("span_quarters"),
        (F.count_if(~F.col("is_consecutive_prev")) - 1).alias("n_breaks_in_sequence"),
        F.max("prev_key_gap").alias("max_key_gap"),
        F.count_if("in_population").alias("population_quarters"),
    )
    return out.withColumn("missing_quarters_inside_span", F.col("span_quarters") - F.col("n_quarters"))


def sequence_breaks(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Rows that do not continue the previous quarter, with the reason."""
    status = settings.columns.decomposition_status
    broken = ~F.col("is_benchmark") & F.col("prev_key_gap").isNotNull() & ~F.col("is_consecutive_prev")
    by_key = F.col("prev_key_gap") != settings.sequence.key_gap
    reason = F.when(by_key, "period_key gap").otherwise("fiscal-end day gap outside range")
    names = ["KEY", "symbol", "period_key", "fiscal_period_end_date", "prev_key_gap", "prev_day_gap", status]
    out = panel.filter(broken).select(*names, "in_population", reason.alias("reason"))
    return out.withColumn("pipeline_says_nonconsecutive", is_true(F.col(status) == "UNCLASSIFIED_NONCONSECUTIVE"))


def top_breaks(breaks: DataFrame, k: int = 3) -> DataFrame:
    """Entities with the most breaks."""
    counted = breaks.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_breaks"))
    return counted.orderBy(F.desc("n_breaks"), "symbol").limit(k)


def consecutive_agreement(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Own consecutiveness against the source's status, as a crosstab (A5)."""
    source = is_true(F.col(settings.columns.decomposition_status) == "UNCLASSIFIED_NONCONSECUTIVE")
    rows = panel.filter(~F.col("is_benchmark")).groupBy((~F.col("is_consecutive_prev")).alias("ours_not_consecutive"))
    return rows.agg(F.count_if(~source).alias("pipeline_false"), F.count_if(source).alias("pipeline_true"))


def signal_funnel(panel: DataFrame, coverage: DataFrame, settings: PanelSettings) -> DataFrame:
    """Members -> rows -> capital -> ratio -> trend -> return, per quarter."""
    c = settings.columns
    stages = panel.filter("in_population").groupBy("period_key")
    stages = stages.agg(
        F.count(F.lit(1)).alias("with_panel_row"),
        F.count(c.ic_raw).alias("with_ic_raw"),
        F.count(c.avg_ic).alias("with_avg_ic"),
        F.count("roic_posttax_q").alias("with_roic_posttax"),
        F.count(settings.trend.main_trend).alias("with_roic_trend"),
        F.count_if(F.col("has_level_and_trend_signals") & F.col("in_evaluation_sample")).alias(
            "common_sort_sample_with_return"
        ),
    )
    return coverage.select("period_key", "index_members").join(stages, "period_key", "full").fillna(0)


def funnel_means(funnel: DataFrame) -> DataFrame:
    """Mean per stage over the steady quarters and the drop from stage to stage.

    Steady = later than the first quarter with a full sample, with a full sample
    itself; if only one quarter has one, that quarter.
    """
    last = "common_sort_sample_with_return"
    full = funnel.filter(F.col(last) > 0)
    first = full.agg(F.min("period_key"), F.count(F.lit(1)).alias("n"))
    first = first.select(F.when(F.col("n") > 1, F.col("min(period_key)")).alias("p")).scalar()
    stages = [n for n in funnel.columns if n != "period_key"]
    means = full.filter(first.isNull() | (F.col("period_key") > first)).agg(*[F.avg(n).alias(n) for n in stages])
    lines = []
    for step, stage in enumerate(stages):
        drop = F.col(stages[step - 1]) - F.col(stage) if step else F.lit(None).cast("double")
        cells = [F.lit(step + 1).alias("step"), F.lit(stage).alias("stage"), F.col(stage).alias("mean_per_quarter")]
        lines.append(F.struct(*cells, drop.alias("drop_from_previous")))
    return means.select(F.inline(F.array(*lines)))


def with_missing_reason(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Population rows without a post-tax ratio, labelled by the first reason that applies (P25)."""
    c = settings.columns
    conditions = (
        F.col("total_current_assets").isNull() | F.col("total_current_liabilities").isNull(),
        F.col("goodwill").isNull(),
        F.col("net_ppe").isNull(),
        F.col(c.ic_raw).isNotNull() & F.col(c.avg_ic).isNull(),
        F.col(c.nopat).isNull(),
        F.col(c.avg_ic) == 0,
    )
    ladder = F.lit(MISSING_REASONS[-1])
    for condition, label in reversed(list(zip(conditions, MISSING_REASONS))):
        ladder = F.when(condition, F.lit(label)).otherwise(ladder)
    rows = panel.filter(F.col("in_population") & F.col("roic_posttax_q").isNull())
    return rows.withColumn("reason", ladder)


def missing_reasons(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Rows per reason and per affected quarter."""
    labelled = with_missing_reason(panel, settings).groupBy("reason", "period_key").agg(F.count(F.lit(1)).alias("n"))
    quarters = labelled.agg(F.count_distinct("period_key")).scalar()
    counted = labelled.groupBy("reason").agg(F.sum("n").alias("rows"))
    return counted.withColumn("rows_per_quarter", F.col("rows") / quarters)


def missing_by_sector(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Reasons as columns per sector with the share of rows lacking the ratio."""
    reasons = with_missing_reason(panel, settings).filter(F.col("sector").isNotNull()).groupBy("sector")
    counts = reasons.agg(
        *[F.count_if(F.col("reason") == r).alias(r) for r in MISSING_REASONS],
        F.count(F.lit(1)).alias("without"),
    )
    base = panel.filter("in_population").groupBy("sector").agg(F.count(F.lit(1)).alias("population_rows"))
    out = counts.join(base, "sector", "left")
    share = (F.col("without") / F.col("population_rows")).alias("share_without_roic")
    return out.select("sector", "population_rows", share, *MISSING_REASONS).orderBy(F.desc("share_without_roic"), "sector")


def single_gap_firms(panel: DataFrame, n_examples: int = 8) -> DataFrame:
    """Goodwill gaps: zero rows, firms that never report it, firms missing only it."""
    gap_only = F.col("goodwill").isNull() & F.col("total_current_assets").isNotNull()
    gap_only &= F.col("total_current_liabilities").isNotNull() & F.col("net_ppe").isNotNull()
    firms = panel.filter(~F.col("is_benchmark")).groupBy("symbol")
    firms = firms.agg(
        F.count_if(is_true(F.col("goodwill") == 0)).alias("zeros"),
        F.count("goodwill").alias("known"),
        F.count_if(gap_only).alias("gaps"),
    )
    shown = firms.filter("gaps > 0").select("symbol").orderBy("symbol").limit(n_examples)
    shown = shown.agg(F.array_join(F.sort_array(F.collect_list("symbol")), ", ")).scalar()
    counts = firms.agg(
        F.sum("zeros").alias("exact_zero_goodwill_rows"),
        F.count_if(F.col("known") == 0).alias("firms_goodwill_always_null"),
        F.count_if(F.col("gaps") > 0).alias("goodwill_only_missing_firms"),
    )
    return counts.withColumn("examples", shown)
