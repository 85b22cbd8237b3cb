"""Depth maps: unprojection and reparametrised depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as la
from ..sources.files import scratch
from .robust import HIGH_SHARE, LOW_SHARE, global_percentiles, index_percentile_range

#: How far ranges are stretched: below, above, and above for the range of all views.
BELOW, ABOVE, COMMON_ABOVE = 10.0, 30.0, 100.0


def positive(depth: Column) -> Column:
    """Void unless positive."""
    return F.when(depth > 0, depth)


def unproject(depth: DataFrame, matrices: DataFrame, key: str = "view", carry: tuple[str, ...] = ()) -> DataFrame:
    """(view, row, col, carry, x, y, z) of valued pixels. matrices: (view, m) with sixteen numbers, row by row."""
    rows = depth.withColumn("d", positive(F.col("depth"))).where("d is not null").join(matrices, key)
    m = [[F.col("m")[4 * i + j] for j in range(4)] for i in range(4)]
    x, y, z, w = la.matvec(m, [F.col("col").cast("double"), F.col("row").cast("double"), F.lit(1.0), F.col("d").cast("double")])
    out = [F.try_divide(v, w).alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))]
    return rows.select(key, "row", "col", *carry, *out).where("z is not null")


def reference_height(points: DataFrame, z: str = "z", share: float = 0.01, margin: float = 20.0) -> Column:
    """Low percentile of all heights less a margin; null without points."""
    (low,) = global_percentiles(points, z, [share])
    return F.lit(None if low is None else low - margin).cast("double")


def _placed(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with name_min and name_max of their key: the values at the index percentiles of its positive ones, stretched.

    Windows over one partitioning: ranges of several values cost one shuffle in all."""
    own = Window.partitionBy(key)
    x = positive(F.col(value))
    rows = rows.withColumn("__x", x).withColumns({"__i": F.row_number().over(own.orderBy(F.col("__x").asc_nulls_last())) - 1, "__n": F.count("__x").over(own)})
    at = lambda p: F.max(F.when(F.col("__i") == F.floor(p * F.col("__n")), F.col("__x"))).over(own)
    return rows.withColumns({f"{name}_min": at(LOW_SHARE) - BELOW, f"{name}_max": at(HIGH_SHARE) + ABOVE}).drop("__x", "__i", "__n")


def reparametrised(obs: DataFrame, points: DataFrame, key: str = "img") -> dict[str, DataFrame]:
    """Depth ranges of views, and those of the depth that is measured from a plane below the scene.

    obs: a row for each point an image sees, with depth (along the axis) and homogeneous w. points: the
    scene's points (z), of which a low percentile is the plane's height; that one number is computed here. Returns ranges
    (raw, reparametrised and last row of each view, in one pass over obs), its parts raw, reparam and
    last_rows, and obs with depth_min and plane_depth.
    """
    ref = reference_height(points)
    plane = _placed(obs, key, "depth", "raw").where("raw_min is not null")
    plane = plane.withColumn("plane_depth", F.try_divide(F.col("raw_min") * (F.col("z") - ref), F.col("w")))
    last = F.array(F.lit(0.0), F.lit(0.0), F.col("raw_min"), -F.col("raw_min") * ref)
    per = _placed(plane, key, "plane_depth", "plane").groupBy(key).agg(*[F.first(c).alias(c) for c in ("raw_min", "raw_max", "plane_min", "plane_max")])
    ranges = per.select("*", last.alias("last_row"))
    part = lambda name: ranges.where(F.col(f"{name}_min").isNotNull()).select(key, F.col(f"{name}_min").alias("depth_min"), F.col(f"{name}_max").alias("depth_max"))
    return {"ranges": ranges, "raw": part("raw"), "reparam": part("plane"), "last_rows": ranges.select(key, "last_row"), "obs": plane.withColumnRenamed("raw_min", "depth_min").drop("raw_max")}


def common_range(plane: DataFrame) -> DataFrame:
    """One row (depth_min, depth_max) for all views, from each track's last image only. plane: the obs of
    ``reparametrised`` with place and track_len. The values are written once, as finding a place among them takes several passes."""
    last = plane.where(F.col("place") == F.col("track_len") - 1).select("plane_depth")
    path = scratch(plane.sparkSession, "plane-depth")
    last.write.parquet(path)
    return index_percentile_range(plane.sparkSession.read.schema(last.schema).parquet(path), [], "plane_depth", BELOW, COMMON_ABOVE)
