"""Point-in-time membership: which entity-quarters belong to the index.

member(ticker, q) <=> start <= q < end, open end = still a member. Both ends
can be switched between inclusive and exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterglass.functions.nulls import is_true
from quarterglass.functions.quarters import ordinal_key
from quarterglass.settings import MembershipRule

# Tickers a careless loader turns into missing values or booleans.
NA_LIKE = ("NA", "NAN", "NULL", "NONE", "N/A", "TRUE", "FALSE")


def last_member_quarter(rule: MembershipRule, end: Column) -> Column:
    return end if rule.end_inclusive else end - 1


def first_member_quarter(rule: MembershipRule, start: Column) -> Column:
    return start if rule.start_inclusive else start + 1


def covers(rule: MembershipRule, q: Column, start: Column, end: Column) -> Column:
    closed = q <= last_member_quarter(rule, end)
    before_end = end.isNull() | closed if rule.open_end_is_member else end.isNotNull() & closed
    return (q >= first_member_quarter(rule, start)) & before_end


def membership(panel: DataFrame, ranges: DataFrame, rule: MembershipRule) -> DataFrame:
    """Every panel row with in_index, relevance_range_id, ticker_in_relevance_file.

    The ticker is an equi-key and the quarter test a residual condition. The
    ranges, which grow with the entities, are dealt by ticker and hashed in
    parts: Spark would judge them by the size of their compressed files and
    broadcast millions. The panel stays on the symbol partitioning and in the
    order its windows already need.
    """
    spans = ranges.select(
        F.col("ticker").alias("__ticker"), F.col("start_ord").alias("__start"), F.col("end_ord").alias("__end"), "range_id"
    )
    hit = (F.col("symbol") == F.col("__ticker")) & covers(rule, F.col("q_ord"), F.col("__start"), F.col("__end"))
    known = ranges.select(F.col("ticker").alias("__known")).distinct()
    return (
        panel.join(spans.hint("shuffle_hash"), hit, "left")
        .join(known.hint("shuffle_hash"), F.col("symbol") == F.col("__known"), "left")
        .withColumns(
            {
                "in_index": F.col("range_id").isNotNull(),
                "relevance_range_id": F.col("range_id"),
                "ticker_in_relevance_file": F.col("__known").isNotNull(),
            }
        )
        .drop("__ticker", "__start", "__end", "range_id", "__known")
    )


def membership_by_rule(panel: DataFrame, ranges: DataFrame, rules: list[MembershipRule]) -> DataFrame:
    """Row-range matches and entities inside the index under each of several end rules, from one join."""
    spans = ranges.select(F.col("ticker").alias("symbol"), F.col("start_ord").alias("__start"), F.col("end_ord").alias("__end"))
    pairs = panel.select("symbol", "q_ord").join(spans, "symbol")
    inside = [is_true(covers(r, F.col("q_ord"), F.col("__start"), F.col("__end"))) for r in rules]
    per_entity = pairs.groupBy("symbol").agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(inside)])
    lines = [
        F.struct(
            F.lit(r.end_inclusive).alias("end_inclusive"),
            F.lit(r.open_end_is_member).alias("open_end_is_member"),
            F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias("rows_in_index"),
            F.count_if(F.col(f"n{i}") > 0).alias("firms_in_index"),
        )
        for i, r in enumerate(rules)
    ]
    return per_entity.agg(F.array(*lines).alias("r")).selectExpr("inline(r)")


def membership_conflicts(matched: DataFrame) -> DataFrame:
    """Entity-quarters that matched more than one range (Q3)."""
    return (
        matched.filter("in_index")
        .groupBy("symbol", "q_ord")
        .agg(F.count(F.lit(1)).alias("n_ranges"))
        .filter("n_ranges > 1")
    )


def expand_members(
    ranges: DataFrame, rule: MembershipRule, first: Column | int, last: Column | int
) -> DataFrame:
    """One row per (ticker, quarter) the ranges imply inside [first, last]."""
    first = F.lit(first) if isinstance(first, int) else first
    last = F.lit(last) if isinstance(last, int) else last
    start = F.greatest(first_member_quarter(rule, F.col("start_ord")), first)
    end = F.when(F.col("end_ord").isNull(), last).otherwise(
        F.least(last_member_quarter(rule, F.col("end_ord")), last)
    )
    # sequence() counts down when lo > hi, so empty ranges leave before it
    spans = ranges.select("ticker", "range_id", start.alias("lo"), end.alias("hi")).filter("lo <= hi")
    return spans.select(
        "ticker", F.explode(F.sequence("lo", "hi")).alias("q_ord"), "range_id"
    ).withColumn("period_key", ordinal_key(F.col("q_ord")))


def overlapping_ranges(ranges: DataFrame, rule: MembershipRule) -> DataFrame:
    """Ranges that start before the previous range of their ticker has ended."""
    order = Window.partitionBy("ticker").orderBy("start_ord", "range_id")
    previous = ranges.withColumns(
        {"prev_start": F.lag("start_ord").over(order), "prev_end_ord": F.lag("end_ord").over(order)}
    )
    clash = F.col("prev_start").isNotNull() & (
        F.col("prev_end_ord").isNull() | (F.col("start_ord") <= last_member_quarter(rule, F.col("prev_end_ord")))
    )
    return previous.filter(clash).select("ticker", "range_id", "start_ord", "end_ord", "prev_end_ord")


def empty_ranges(ranges: DataFrame, rule: MembershipRule) -> DataFrame:
    """Ranges without a single quarter under the exclusive-end rule."""
    empty = F.lit(False) if rule.end_inclusive else is_true(F.col("end_ord") == F.col("start_ord"))
    return ranges.filter(empty).select("ticker", "start_quarter", "end_quarter")


def ranges_report(ranges: DataFrame) -> DataFrame:
    """Structure counts of the range table in one row."""
    per_ticker = ranges.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("end_ord") < F.col("start_ord")).alias("reversed"),
        F.count_if(F.col("end_ord") == F.col("start_ord")).alias("same"),
        F.count_if(F.col("open_end")).alias("open"),
    )
    return per_ticker.agg(
        F.sum("n").alias("n_ranges"),
        F.count("ticker").alias("n_tickers"),
        F.count_if(F.col("n") > 1).alias("n_tickers_with_multiple_ranges"),
        F.sum("reversed").alias("n_end_before_start"),
        F.sum("same").alias("n_start_equals_end"),
        F.sum("open").alias("n_open_end"),
        F.sum(F.when(F.upper("ticker").isin(*NA_LIKE), F.col("n")).otherwise(0)).alias("n_na_like_tickers"),
    )


def validate_ranges(ranges: DataFrame, rule: MembershipRule) -> None:
    """Fail fast on reversed or overlapping ranges."""
    if ranges.filter(F.col("end_ord") < F.col("start_ord")).limit(1).collect():
        raise ValueError("membership ranges with end_quarter < start_quarter")
    clashes = overlapping_ranges(ranges, rule).select("ticker").distinct().orderBy("ticker").limit(20).collect()
    if clashes:
        raise ValueError(f"Overlapping membership ranges for: {[r.ticker for r in clashes]}")
