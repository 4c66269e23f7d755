"""Sharding by sampled splitters: equal bytes in every shard, over one order of all records.

Records are ordered by (hash of the text, id). A size-weighted sample gives quantile boundaries of that order; ranges
between boundaries are counted exactly, overfull ones are split again from a sample of their own, and prefix sums over
ranges turn the place inside a range into the place among all records. A shard is an interval of that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterglass.llm.common import settle, uniform


def range_of(key: np.ndarray, tie: np.ndarray, cut_keys: np.ndarray, cut_ties: np.ndarray) -> np.ndarray:
    """Number of boundaries (key, tie) at or below each record's, in the order of (key, tie)."""
    low, high = np.searchsorted(cut_keys, key, "left"), np.searchsorted(cut_keys, key, "right")
    place = high.copy()
    for i in np.flatnonzero(high > low):
        place[i] = low[i] + np.searchsorted(cut_ties[low[i] : high[i]], tie[i], "right")
    return place


def _cut(base: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """The records with their range; the boundaries are a bounded list."""
    keys, ties = (np.array([c[i] for c in cuts], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, tie in batches:
            yield pd.Series(range_of(key.to_numpy(), tie.to_numpy(), keys, ties).astype("int32"))

    return base.withColumn("range", place("key", "tie"))


def _splitters(base: DataFrame, total: int, ranges: int, seed: int, oversample: int) -> list[tuple[int, int]]:
    """Quantile boundaries, ``ranges`` - 1 at most, of a sample of about ``ranges * oversample`` records drawn by size.

    A record of more than one sampling step counts as often as it holds steps. The sample has that many rows whatever
    the input's size; it is sorted in one task and only the boundaries reach the driver.
    """
    step = max(1.0, total / (ranges * oversample))
    drawn = base.filter(uniform(seed, F.col("key"), F.col("tie")) < F.col("size") / step)
    weighted = drawn.select("key", "tie", F.greatest(F.col("size") / step, F.lit(1.0)).alias("weight"))
    order = W.orderBy("key", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = weighted.withColumn("upto", F.sum("weight").over(order)).withColumn("all", F.sum("weight").over(W.partitionBy()))
    quantile = F.floor(F.col("upto") * ranges / F.col("all"))
    cut = running.groupBy(quantile.alias("q")).agg(F.min(F.struct("key", "tie")).alias("cut")).filter("q > 0")
    return sorted({(r.cut.key, r.cut.tie) for r in cut.limit(ranges + 1).collect()})


def shard(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 11,
    fineness: int = 16,
    oversample: int = 32,
    rounds: int = 3,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row, by the law ``bytes``.

    Size is the text's UTF-8 bytes plus 8; NULL text has none and the CRC of no bytes. Rows of equal text stay in one
    shard unless together they are larger than both a sixteenth of a shard and the largest record: such a group is
    subdivided by id. NULL ids order before all others; repeated rows are rows of their own. ``slot`` counts the shard's
    records from 0 in the order of (hash, id). An empty table gives no row; fewer records than shards leave shards empty.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("tie"),
    )
    base = settle(base, "shard")
    total, largest = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    ranges = shards * fineness
    cuts = _splitters(base, total, ranges, seed, oversample)
    mean = max(1.0, total / ranges)
    for turn in range(1, rounds):
        counted = _cut(base, cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        over = counted.filter((F.col("bytes") > 2 * mean) & (F.col("n") > 1)).agg(F.collect_set("range"), F.sum("bytes")).first()
        if not over[0]:
            break
        inside = _cut(base, cuts).filter(F.col("range").isin([int(r) for r in over[0]]))  # at most half of the ranges
        more = _splitters(inside, over[1], int(2 * over[1] / mean) + 1, seed + turn, oversample)
        cuts = sorted({*cuts, *more})

    placed = settle(_cut(base, cuts), "ranges")
    totals = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row per range: a bounded number
    starts = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("byte_start"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("row_start"),
    )
    inside = W.partitionBy("range").orderBy("key", "tie").rowsBetween(W.unboundedPreceding, -1)
    ordered = (
        placed.join(starts, "range")
        .withColumn("first_byte", F.col("byte_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("place", F.col("row_start") + F.count("*").over(inside))
    )
    ordered = settle(ordered, "order")
    # Stored, so that the join below has a shuffle on either side and a group of any size is split.
    groups = settle(ordered.groupBy("key").agg(F.min("first_byte").alias("group_byte"), F.sum("size").alias("group_size")), "groups")
    together = F.col("group_size") <= F.greatest(F.lit(total / shards / 16.0), F.lit(largest))
    middle = F.when(together, F.col("group_byte") + F.col("group_size") / 2).otherwise(F.col("first_byte") + F.col("size") / 2)
    put = ordered.join(groups, "key").withColumn(
        "shard", F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int")
    )
    firsts = put.groupBy("shard").agg(F.min("place").alias("first_place"))
    return put.join(F.broadcast(firsts), "shard").select(  # a row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first_place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
