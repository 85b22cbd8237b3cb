"""A running surface over a stream of points.

An addition of this library: the batch workload has no streams. The largest height of a cell
is a stateful aggregate; with a watermark and time windows its state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_grid_max(points: DataFrame, when: str, late: str, window: str, row: Column, col: Column, value: Column, rows: int, cols: int) -> DataFrame:
    """(start, row, col, z, n) of each time window and cell; points later than ``late`` are left out."""
    cells = points.withWatermark(when, late).select(F.col(when).alias("__t"), row.cast("int").alias("row"), col.cast("int").alias("col"), value.alias("z"))
    cells = cells.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1) & F.col("z").isNotNull())
    out = cells.groupBy(F.window("__t", window).alias("w"), "row", "col").agg(F.max("z").alias("z"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "row", "col", "z", "n")
