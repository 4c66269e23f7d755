"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def save_table(table: DataFrame, path: str) -> int:
    """Report table as CSV with a header (S7); returns its number of rows, counted by the write itself."""
    rows = Observation()
    counted = table.observe(rows, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("header", True).csv(path)
    return rows.get["rows"]


def save_panel(panel: DataFrame, path: str) -> int:
    """Full panel as Parquet (S8); the write also cuts lineage for the audits that re-read it. Returns its number of rows."""
    rows = Observation()
    panel.observe(rows, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return rows.get["rows"]


def save_clustered(frame: DataFrame, name: str, path: str | None = None, buckets: int = 64, entity: str = "symbol", order: str = "q_ord") -> DataFrame:
    """The frame as a table bucketed by entity and sorted by quarter, read back.

    A bucket is one file: windows by entity and joins of tables with as many buckets need no exchange. ``path`` has to be
    shared by all executors; without it the warehouse takes the table.
    """
    writer = frame.repartition(buckets, entity).write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, entity).sortBy(entity, order)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return frame.sparkSession.table(name)


def save_manifest(manifest: DataFrame, path: str) -> None:
    """Run manifest as JSON."""
    manifest.write.mode("overwrite").json(path)
