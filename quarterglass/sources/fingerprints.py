"""Content digests of tables, computed by Spark, and whether two states of a table are the same.

A column's digest is its number of values and the exact sum over rows of a 48-bit hash of each value's canonical text, so
it needs one pass with partial sums, depends on no order, and shows which column changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(name: str, kind: T.DataType) -> Column:
    """Text of a value that other engines write the same: numbers with a fraction in millionths, times in microseconds."""
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(value.cast("double") * 1_000_000).cast("decimal(38,0)").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value) if not isinstance(kind, T.MapType) else F.to_json(F.array_sort(F.map_entries(value)))
    return value.cast("string")


def content_digest(frame: DataFrame) -> DataFrame:
    """(column, n_rows, n_values, checksum): one row per column."""
    lines = []
    for field in frame.schema.fields:
        text = canonical(field.name, field.dataType)
        digest = F.md5(text.cast("binary"))
        # 24 bits at a time: sums of longs stay exact over 2 ** 39 rows
        high, low = (F.sum(F.conv(F.substring(digest, at, 6), 16, 10).cast("long")).cast("decimal(20,0)") for at in (1, 7))
        checksum = high * F.lit(2**24) + low
        lines.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(text).alias("n_values"),
                F.coalesce(checksum, F.lit(0)).cast("decimal(38,0)").cast("string").alias("checksum"),
            )
        )
    return frame.agg(F.array(*lines).alias("r")).selectExpr("inline(r)")


def digest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per column of two digests: rows before and after, and whether the content is unchanged."""
    old = before.select("column", F.col("n_rows").alias("rows_before"), F.struct("n_rows", "n_values", "checksum").alias("b"))
    new = after.select("column", F.col("n_rows").alias("rows_after"), F.struct("n_rows", "n_values", "checksum").alias("a"))
    joined = old.join(new, "column", "full")
    return joined.select("column", "rows_before", "rows_after", F.col("b").eqNullSafe(F.col("a")).alias("unchanged"))


def require_unchanged(before: DataFrame, after: DataFrame) -> None:
    """Fail when a source's content changed during the run (Q5)."""
    changed = digest_diff(before, after).filter(~F.col("unchanged")).select("column").orderBy("column").limit(10).collect()
    if changed:
        raise RuntimeError(f"source columns changed during the run: {[r.column for r in changed]}")
