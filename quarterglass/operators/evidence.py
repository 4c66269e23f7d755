"""What the forward-return column measures, judged from prices and dates in the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterglass.functions.nulls import is_true, positive_or_null, ratio
from quarterglass.operators.quantiles import pair_counts, pair_moments, ranked_values
from quarterglass.operators.sequence import by_entity
from quarterglass.settings import PanelSettings

# Lag classes of the evidence table (label, lowest and highest lag in days).
LAG_CLASSES = (
    ("fiscal end = formation date (lag 0 days)", 0, 0),
    ("fiscal end = formation - ~1 month", 25, 35),
    ("fiscal end = formation - ~2 months (calendar quarters)", 55, 65),
)
_BENCHMARK_LABEL = "SPY/QQQ rows: fiscal_period_end_date equals formation_date (quarter end + 2 months)"


def return_alignment(panel: DataFrame, settings: PanelSettings) -> DataFrame:
    """Correlation and median distance of the stored return to the next and the last price change."""
    c, w = settings.columns, by_entity()
    moved = panel.withColumns(
        {
            "__next": F.lead(c.price).over(w),
            "__prev": F.lag(c.price).over(w),
            "__next_link": F.lead("is_consecutive_prev").over(w),
        }
    )
    price = positive_or_null(F.col(c.price))
    fwd = ratio(positive_or_null(F.col("__next")), price) - 1
    bwd = ratio(price, positive_or_null(F.col("__prev"))) - 1
    stored = F.col(c.forward_return)
    usable = ~F.col("is_benchmark") & stored.isNotNull() & ~F.col("fwd_return_window_unrealized")
    same = F.when(F.col("is_benchmark"), is_true(F.col(c.fiscal_end) == F.col("formation_date")).cast("double"))
    pairs = [(same, F.lit(0.0))]
    for _, low, high in LAG_CLASSES:
        in_class = usable & F.col("signal_lag_days").between(low, high)
        ahead = is_true(in_class & F.col("__next_link") & fwd.isNotNull())
        behind = is_true(in_class & F.col("is_consecutive_prev") & bwd.isNotNull())
        pairs += [(F.when(ahead, stored), fwd), (F.when(behind, stored), bwd)]
    # the panel is read once: counts, shares, correlations and medians come from the counted pairs
    counted = pair_counts(moved, pairs)
    moments = pair_moments(counted).select("fid", "n", F.when(F.col("n") > 2, F.col("correlation")).alias("correlation"))
    shares = counted.filter(F.col("fid") == 0).groupBy("fid").agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("share"))
    distances = ranked_values(counted.select("fid", F.abs(F.col("a") - F.col("b")).alias("value"), "n"), [0.5])
    distances = distances.select("fid", F.col("quantile").alias("median"))
    found = moments.join(F.broadcast(shares), "fid", "left").join(F.broadcast(distances), "fid", "left")  # one row per pair

    def line(n: int, evidence: str, fid: int, value: str, metric: str):
        cells = {"line": n, "evidence": evidence, "fid": fid, "which": value, "metric": metric}
        return F.struct(*[F.lit(v).alias(k) for k, v in cells.items()])

    lines = [line(0, _BENCHMARK_LABEL, 0, "share", "share equal")]
    for i, (label, _, _) in enumerate(LAG_CLASSES):
        ahead, behind = 2 * i + 1, 2 * i + 2
        lines += [
            line(3 * i + 1, f"{label}: corr(FQR[t], price[t+1]/price[t]-1)", ahead, "correlation", "correlation"),
            line(3 * i + 2, f"{label}: median |FQR[t] - (price[t+1]/price[t]-1)|", ahead, "median", "median abs diff"),
            line(3 * i + 3, f"{label}: corr(FQR[t], price[t]/price[t-1]-1) (wrong alignment)", behind, "correlation", "correlation"),
        ]
    table = panel.sparkSession.range(1).select(F.inline(F.array(*lines))).join(F.broadcast(found), "fid", "left").orderBy("line")
    value = F.when(F.col("which") == "share", F.col("share")).when(F.col("which") == "median", F.col("median")).otherwise(F.col("correlation"))
    return table.select("evidence", F.coalesce("n", F.lit(0).cast("long")).alias("n"), value.alias("value"), "metric")
