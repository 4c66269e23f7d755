"""Duplicate keys, counted with map-side aggregation so that no hot key meets one task."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need pyarrow, not this package

# The key sets the duplicate report looks at.
KEY_SETS = (("symbol", "period_key"), ("symbol", "fiscal_period_end_date"), ("KEY",))


def key_counts(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; equal NULLs count as equal."""
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def duplicated_rows(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once (W16, keep-all)."""
    repeated = key_counts(panel, keys).drop("n_rows").alias("k")
    same = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys])
    return panel.alias("p").join(repeated, same, "left_semi")


def duplicates_report(panel: DataFrame, n_examples: int = 10) -> DataFrame:
    """Per key set: rows involved and the smallest KEYs among them.

    Rows are melted into one row per key set, so all sets are counted at once; rows of repeated keys are then ranked, where
    each task hands on its ``n_examples`` smallest only.
    """
    keys = [F.struct(*[F.col(name).cast("string").alias(f"k{i}") for i, name in enumerate((*s, s[0])[:2])]) for s in KEY_SETS]
    long = panel.select("KEY", F.posexplode(F.array(*keys)).alias("n", "k")).select("n", "k.k0", "k.k1", "KEY")
    repeated = long.groupBy("n", "k0", "k1").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    totals = repeated.groupBy("n").agg(F.sum("rows").alias("rows"))
    same = (F.col("a.n") == F.col("b.n")) & F.col("a.k0").eqNullSafe(F.col("b.k0")) & F.col("a.k1").eqNullSafe(F.col("b.k1"))
    rows = long.alias("a").join(repeated.alias("b"), same, "left_semi")
    rank = F.row_number().over(Window.partitionBy("n").orderBy("KEY"))
    top = rows.select("n", "KEY").withColumn("rank", rank).filter(F.col("rank") <= n_examples)
    shown = top.groupBy("n").agg(F.array_join(F.sort_array(F.collect_list("KEY")), "; ").alias("examples"))
    found = F.broadcast(totals.join(F.broadcast(shown), "n"))  # one row per key set
    labels = F.array(*[F.lit(" + ".join(s)) for s in KEY_SETS])
    lines = panel.sparkSession.range(1).select(F.posexplode(labels).alias("n", "key")).join(found, "n", "left").orderBy("n")
    return lines.select("key", F.coalesce("rows", F.lit(0).cast("long")).alias("duplicated_rows"), F.coalesce("examples", F.lit("")).alias("examples"))


def uniqueness_verdict(panel: DataFrame, keys: Sequence[str] = ("symbol", "q_ord")) -> DataFrame:
    """One row: how many keys repeat and how many rows they cover (Q1, O2)."""
    return key_counts(panel, keys).agg(
        F.count(F.lit(1)).alias("repeated_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows_involved")
    )


def require_unique(panel: DataFrame, keys: Sequence[str] = ("symbol", "q_ord")) -> None:
    """Fail fast, with at most five example keys."""
    found = key_counts(panel, keys).limit(5).collect()
    if found:
        examples = [tuple(row[k] for k in keys) for row in found]
        raise ValueError(f"rows share {tuple(keys)}: {examples}")


def _packed_keys(batches: Iterator[pa.RecordBatch], rows: int = 131_072) -> Iterator[pa.RecordBatch]:
    """Pieces of (bucket, key, b, a) rows, summed by key, as a row of arrays per bucket."""
    held, n = [], 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        by_key = pa.Table.from_batches(held).group_by(["bucket", "key"], use_threads=False).aggregate([("b", "sum"), ("a", "sum")])
        by_bucket = by_key.group_by("bucket", use_threads=False).aggregate([("key", "list"), ("b_sum", "list"), ("a_sum", "list")])
        yield from by_bucket.select(["bucket", "key_list", "b_sum_list", "a_sum_list"]).rename_columns(["bucket", "key", "b", "a"]).to_batches()

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield from handed_on()
            held, n = [], 0
    if n:
        yield from handed_on()


def _compared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rows_before, lost, added) of each bucket of packed keys, which come one after the other."""

    def compared(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        flat = pa.table({name: pa.concat_arrays([part.column(i).flatten() for part in parts]) for i, name in ((1, "key"), (2, "b"), (3, "a"))})
        counts = flat.group_by("key", use_threads=False).aggregate([("b", "sum"), ("a", "sum")])
        more = pc.subtract(counts["b_sum"], counts["a_sum"])
        found = (counts["b_sum"], pc.max_element_wise(more, 0), pc.max_element_wise(pc.negate(more), 0))
        return pa.RecordBatch.from_arrays([pa.array([pc.sum(c).as_py()], pa.int64()) for c in found], ["rows_before", "lost", "added"])

    at, parts = None, []
    for batch in batches:
        buckets, first = batch.column(0).to_pylist(), 0
        while first < len(buckets):
            if buckets[first] != at:
                if parts:
                    yield compared(parts)
                at, parts = buckets[first], []
            end = first
            while end < len(buckets) and buckets[end] == at:
                end += 1
            parts.append(batch.slice(first, end - first))
            first = end
    if parts:
        yield compared(parts)


def multiset_difference(before: DataFrame, after: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """One row: the rows of ``before``, how many of its keys ``after`` has too few of (``lost``) and too many (``added``).

    Tasks sum pieces of rows by key and hand them on in arrays, a row per bucket of keys; buckets are compared one by one,
    so that no task holds a table of all its keys. Equal NULLs count as equal.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    text = F.col(key).cast("string").alias("key")
    rows = before.select(text, one.alias("b"), none.alias("a")).unionByName(after.select(text, none.alias("b"), one.alias("a")))
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key", "b", "a")
    packed = rows.mapInArrow(_packed_keys, "bucket int, key array<string>, b array<long>, a array<long>").repartition("bucket")
    found = packed.sortWithinPartitions("bucket").mapInArrow(_compared_keys, "rows_before long, lost long, added long")
    return found.agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("rows_before", "lost", "added")])
