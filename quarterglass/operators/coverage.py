"""Index members against panel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterglass.functions.nulls import is_true
from quarterglass.operators.membership import last_member_quarter
from quarterglass.settings import MembershipRule


def study_window(panel: DataFrame) -> DataFrame:
    """One row: first and last quarter of the panel."""
    return panel.agg(F.min("q_ord").alias("first_ord"), F.max("q_ord").alias("last_ord"))


def coverage_by_quarter(members: DataFrame, panel: DataFrame) -> DataFrame:
    """Members per quarter split into present, ticker absent, row absent."""
    have = panel.select(F.col("symbol").alias("ticker"), "q_ord").dropna().distinct().withColumn("has_row", F.lit(True))
    known = panel.select(F.col("symbol").alias("ticker")).dropna().distinct().withColumn("known", F.lit(True))
    joined = members.join(have, ["ticker", "q_ord"], "left").join(known, "ticker", "left")
    counted = joined.groupBy("q_ord", "period_key").agg(
        F.count(F.lit(1)).alias("index_members"),
        F.count("has_row").alias("members_with_panel_row"),
        F.count_if(F.col("known").isNull()).alias("members_ticker_absent_from_panel"),
    )
    present, absent = F.col("members_with_panel_row"), F.col("members_ticker_absent_from_panel")
    return counted.withColumns(
        {
            "members_ticker_in_panel_but_no_row": F.col("index_members") - present - absent,
            "coverage_share": present / F.col("index_members"),
        }
    ).drop("q_ord")


def missing_members(
    ranges: DataFrame, panel: DataFrame, first_ord, rule: MembershipRule, manifest: DataFrame | None = None
) -> DataFrame:
    """Ranges inside the study window whose ticker has no panel row at all."""
    reaches = F.col("end_ord").isNull() | is_true(last_member_quarter(rule, F.col("end_ord")) >= first_ord)
    known = panel.select(F.col("symbol").alias("ticker")).distinct()
    missing = ranges.filter(reaches).join(known, "ticker", "left_anti")
    missing = missing.select("ticker", "start_quarter", "end_quarter", "open_end")
    if manifest is not None:
        info = manifest.select(
            F.col("symbol").alias("ticker"),
            F.col("status").alias("download_status"),
            F.col("error").alias("download_error"),
        )
        missing = missing.join(info, "ticker", "left")
    return missing.orderBy(F.desc("open_end"), F.desc("end_quarter"), F.asc("ticker"))


def reused_tickers(ranges: DataFrame, panel: DataFrame) -> DataFrame:
    """Tickers with several ranges and what the panel holds for each."""
    repeated = ranges.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ticker")
    multi = ranges.join(repeated, "ticker", "left_semi").select("ticker", "start_quarter", "end_quarter", "range_id")
    rows = panel.join(repeated, F.col("symbol") == F.col("ticker"), "left_semi")

    # names are de-duplicated before they are collected; a name's rank is its first quarter
    names = rows.groupBy("symbol", "company").agg(
        F.min("q_ord").alias("since"), F.min("period_key").alias("lo"), F.max("period_key").alias("hi")
    )
    named = F.filter(F.sort_array(F.collect_list(F.struct("since", "company"))), lambda s: s["company"].isNotNull())
    info = names.groupBy(F.col("symbol").alias("ticker")).agg(
        F.array_join(F.transform(named, lambda s: s["company"]), "; ").alias("panel_company"),
        F.min("lo").alias("panel_first"),
        F.max("hi").alias("panel_last"),
    )
    matched = rows.filter(F.col("relevance_range_id").isNotNull()).groupBy(
        F.col("relevance_range_id").alias("range_id")
    )
    matched = matched.agg(
        F.count(F.lit(1)).alias("panel_rows_matched"),
        F.min("period_key").alias("matched_first"),
        F.max("period_key").alias("matched_last"),
    )
    out = multi.join(info, "ticker", "left").join(matched, "range_id", "left")
    out = out.withColumn("panel_rows_matched", F.coalesce("panel_rows_matched", F.lit(0)))
    used = out.groupBy("ticker").agg(F.count_if(F.col("panel_rows_matched") > 0).alias("n_used"))
    out = out.join(used, "ticker").withColumn("ticker_rows_span_several_ranges", F.col("n_used") > 1)
    return out.drop("range_id", "n_used")
