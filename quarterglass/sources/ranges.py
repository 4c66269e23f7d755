"""Membership ranges from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterglass.functions.quarters import key_ordinal, valid_key
from quarterglass.settings import LoadRule
from quarterglass.sources.panel_text import read_csv_text

RANGE_COLUMNS = ("ticker", "start_quarter", "end_quarter")


def number_rows(frame: DataFrame, name: str) -> DataFrame:
    """Consecutive numbers in scan order, counted per input split.

    Only one count per split is ranked in one place; rows are never gathered.
    """
    marked = frame.withColumns({"__split": F.spark_partition_id(), "__id": F.monotonically_increasing_id()})
    splits = marked.groupBy("__split").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__split", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = marked.join(F.broadcast(offsets), "__split").withColumn(name, F.col("__offset") + inside)
    return numbered.drop("__split", "__id", "__n", "__offset")


def type_ranges(text: DataFrame, rule: LoadRule) -> DataFrame:
    """Trimmed texts, quarter ordinals and the open-end flag."""
    trimmed = text.withColumns({n: F.trim(F.coalesce(F.col(n), F.lit(""))) for n in RANGE_COLUMNS})
    start, end = (key_ordinal(valid_key(F.col(n), rule.period_key_regex)) for n in ("start_quarter", "end_quarter"))
    return trimmed.withColumns({"start_ord": start, "end_ord": end, "open_end": F.col("end_quarter") == ""})


def load_ranges(spark: SparkSession, path: str, rule: LoadRule) -> DataFrame:
    """Range file in file order; ``range_id`` is the row number from zero."""
    return type_ranges(number_rows(read_csv_text(spark, path, RANGE_COLUMNS), "range_id"), rule)


def ranges_load_report(ranges: DataFrame) -> DataFrame:
    """Row, ticker, open-end and invalid-quarter counts in one row."""
    tickers = ranges.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("start_ord").isNull()).alias("bad_start"),
        F.count_if("open_end").alias("open"),
        F.count_if(~F.col("open_end") & F.col("end_ord").isNull()).alias("bad_end"),
    )
    return tickers.agg(
        F.sum("n").alias("n_rows"),
        F.count("ticker").alias("n_unique_tickers"),
        F.sum(F.when(F.col("ticker") == "", F.col("n")).otherwise(0)).alias("n_empty_ticker"),
        F.sum("bad_start").alias("n_invalid_start"),
        F.sum("open").alias("n_open_end"),
        F.sum("bad_end").alias("n_invalid_end"),
    )
