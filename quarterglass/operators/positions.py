"""Row positions in a whole ordered table, and samples by position, without one task that sees all rows.

Splitters are drawn from the table's own keys, rows fall between them, the runs between splitters are counted, and a row's
position is the count of the runs before its own plus its place in it. Splitters are the keys of smallest hash, so they
are the same whenever and wherever the plan runs again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_runs(frame: DataFrame, order: Sequence[str], runs: int) -> DataFrame:
    """All columns and ``__run``, the number of splitters that are not above a row's key."""
    key = F.struct(*order)
    drawn = frame.select(key.alias("k")).withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(runs * 32)
    every = F.filter(F.sort_array(F.collect_list("k")), lambda _, i: i % 32 == 16)  # from sample to splitters: every 32nd key
    splitters = drawn.agg(every.alias("s")).scalar()
    # splitters are in order, so their number up to the key is found by halving: one comparison per power of two
    steps = F.array(*[F.lit(1 << k) for k in range(runs.bit_length(), -1, -1)])
    upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__s", at + step - 1) <= key, at + step).otherwise(at))
    return frame.withColumn("__s", splitters).withColumn("__run", upto).drop("__s")


def with_position(frame: DataFrame, order: Sequence[str], runs: int = 64, name: str = "position") -> DataFrame:
    """All columns and each row's place, from 0, in the order of the columns ``order``, NULLs first; with it ``n_total``.

    The order columns have to tell rows apart, or equal rows share their places in any order. A run holds about one part in
    ``runs`` of the rows and is sorted by one task; more rows call for more runs.
    """
    placed = in_runs(frame, order, runs)
    counts = placed.groupBy("__run").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__run"))  # a row per run
    total = F.sum("__n").over(Window.partitionBy())
    before = counts.select("__run", (upto - F.col("__n")).alias("__before"), total.alias("n_total"))
    inside = F.row_number().over(Window.partitionBy("__run").orderBy(*order))
    ranked = placed.withColumn("__at", inside).join(F.broadcast(before), "__run")
    return ranked.withColumn(name, F.col("__before") + F.col("__at") - 1).drop("__run", "__before", "__at")


def positional_sample(frame: DataFrame, order: Sequence[str], every: int = 4, start: int = 1, last: int = 2, runs: int = 64) -> DataFrame:
    """The first row, each ``every``-th from ``start`` on, and the ``last`` ones, with their positions."""
    at = F.col("position")
    kept = (at == 0) | ((at >= start) & ((at - start) % every == 0)) | (at >= F.col("n_total") - last)
    return with_position(frame, order, runs).filter(kept).drop("n_total")
