"""Extension: running cell counts of an append-only panel, and a writer that keeps the latest counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_cells(stream: DataFrame, axes: list[str], event_time: str | None = None, lateness: str = "1 hour", window: str | None = None) -> DataFrame:
    """Rows per cell so far; with a window, per event-time window, closed by the watermark."""
    if window:
        return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), *axes).agg(F.count("*").alias("rows"))
    return stream.groupBy(*axes).agg(F.count("*").alias("rows"))


def status(cells: DataFrame, replicates: int = 1) -> DataFrame:
    """complete, under or over for each running cell."""
    n = F.col("rows")
    return cells.withColumn("status", F.when(n == replicates, "complete").when(n < replicates, "under_replicated").otherwise("over_replicated"))
