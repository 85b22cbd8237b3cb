"""From image metadata to a fused surface: the workload's chains as lazy plans, and a step runner.

Each function is one stage between two tables; a step's result is a DataFrame, so a barrier
exists only where a caller writes it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, image, rpc
from ..operators import depth, fit, meta, raster, robust, sparse

# fixed values: the steps as configurations name them, and the lattice that cameras are fitted to
STEPS = ("clean_data", "crop_image", "derive_approx", "choose_subset", "colmap_sfm_perspective", "inspect_sfm_perspective", "reparam_depth", "colmap_mvs", "aggregate_2p5d", "aggregate_3d")
GRID_POINTS, GRID_HEIGHTS = 100, 20


@dataclass(frozen=True)
class Area:
    """The area of interest: UTM box, heights, and the resolution of its surface."""

    zone: int
    south: bool
    ul_e: float
    ul_n: float
    width: float
    height: float
    alt_min: float
    alt_max: float
    res: float = 0.5

    @property
    def rows(self) -> int:
        return int(self.height / self.res) + 1

    @property
    def cols(self) -> int:
        return int(self.width / self.res) + 1

    def lattice(self, spark: SparkSession, n: int = GRID_POINTS, heights: int = GRID_HEIGHTS) -> DataFrame:
        """(east, north, alt, lat, lon) of n x n x heights points, heights outermost."""
        g = raster.lattice(spark, heights, n, n).toDF("k", "i", "j")
        g = g.select(raster.linspace(F.col("i"), self.ul_e, self.ul_e + self.width, n).alias("east"), raster.linspace(F.col("j"), self.ul_n, self.ul_n - self.height, n).alias("north"), raster.linspace(F.col("k"), self.alt_min, self.alt_max, heights).alias("alt"))
        return g.select("*", geodesy.from_utm(F.col("east"), F.col("north"), self.zone, self.south).alias("p")).select("east", "north", "alt", "p.*")


def usable_images(metas: DataFrame, area: Area) -> DataFrame:
    """Images that pass the metadata filters, with the crop that covers the area and offsets moved to it.

    Cheap filters come first; the corner lattice has eight points, so the cross join is one
    row of the broadcast side for each of eight."""
    spark = metas.sparkSession
    corners = area.lattice(spark, 2, 2)
    good = meta.cloud_filter(meta.sensor_filter(metas, F.col("sensor_id")), F.col("cloudCover"))
    seen = good.crossJoin(F.broadcast(corners.select("lat", "lon", "alt")))
    col, row = rpc.project(F.col("rpc"), F.col("lat"), F.col("lon"), F.col("alt"))
    box = meta.rounded_box(seen.select("name", col.alias("c"), row.alias("r")), ["name"], F.col("c"), F.col("r")).withColumnsRenamed({"width": "box_w", "height": "box_h"})
    both = good.join(box, "name")
    both = both.withColumn("o", image.overlap([F.lit(0), F.lit(0), F.col("width"), F.col("height")], [F.col("ul_col"), F.col("ul_row"), F.col("box_w"), F.col("box_h")]))
    kept = both.where(F.col("o.second") >= meta.OVERLAP_LIMIT)
    kept = kept.withColumns({"ul_col_original": F.col("o.x"), "ul_row_original": F.col("o.y"), "width": F.col("o.w").cast("int"), "height": F.col("o.h").cast("int")})
    kept = meta.crop_rebase(kept, "rpc", F.col("ul_col_original"), F.col("ul_row_original"))
    return meta.chronological(kept.drop("o", "ul_col", "ul_row", "box_w", "box_h"), "capTime", "name")


def camera_samples(images: DataFrame, area: Area, origin: tuple[float, float, float], n: int = GRID_POINTS, heights: int = GRID_HEIGHTS) -> DataFrame:
    """(name, x, y, z, col, row): lattice points about the origin and where each image sees them, inside it only.

    The lattice has a size that its parameters fix, so it is what is broadcast; images are dealt out."""
    grid = area.lattice(images.sparkSession, n, heights)
    enu = geodesy.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), *origin)
    grid = grid.select("lat", "lon", "alt", *[c.alias(a) for c, a in zip(enu, "xyz")])
    both = images.select("name", "rpc", "width", "height").repartition("name").crossJoin(F.broadcast(grid))
    col, row = rpc.project(F.col("rpc"), F.col("lat"), F.col("lon"), F.col("alt"))
    return both.select("name", "x", "y", "z", col.alias("col"), row.alias("row"), "width", "height").where(image.inside(F.col("col"), F.col("row"), F.col("width"), F.col("height"))).drop("width", "height")


def perspective_cameras(samples: DataFrame) -> DataFrame:
    """(name, camera pieces, six error figures) of a direct linear fit for each image."""
    cams = fit.dlt_fit(samples, "name").where("k is not null")
    both = samples.join(cams, "name")  # matrices are columns of the camera table: computed once a camera
    k, r = ([[F.col(c)[3 * i + j] for j in range(3)] for i in range(3)] for c in ("k", "r"))
    t = [F.col("t")[i] for i in range(3)]
    proj, inv = sparse.projection_errors(k, r, t, [F.col(a) for a in "xyz"], F.col("col"), F.col("row"))
    errors = sparse.camera_error(both.select("name", proj.alias("p"), inv.alias("i")), ["name"], F.col("p"), F.col("i"))
    return cams.join(errors, "name")


def points_to_utm(points: DataFrame, origin: tuple[float, float, float], area: Area) -> DataFrame:
    """``points`` (x, y, z about the origin) with east, north, alt."""
    kept = [c for c in points.columns if c not in ("lat", "lon", "alt", "east", "north")]
    out = points.select(*kept, geodesy.enu_to_geodetic(F.col("x"), F.col("y"), F.col("z"), *origin).alias("p"))
    out = out.select(*kept, "p.*").withColumn("q", geodesy.to_utm(F.col("lat"), F.col("lon"), area.zone, area.south))
    return out.select(*kept, "lat", "lon", "alt", "q.*")


def surfaces(points: DataFrame, area: Area, keys: list[str]) -> DataFrame:
    """(keys, row, col, z): highest point of each cell, holes filled once, median filtered. points: east, north, alt."""
    row, col = raster.cell_of(F.col("east"), F.col("north"), area.ul_e, area.ul_n, area.res, area.res)
    top = raster.grid_max(points, keys, row, col, F.col("alt"), area.rows, area.cols)
    return raster.median3x3(raster.hole_fill(top, area.rows, area.cols, keys), area.rows, area.cols, keys)


def fused_surface(depths: DataFrame, matrices: DataFrame, origin: tuple[float, float, float], area: Area) -> DataFrame:
    """(row, col, z, n) of all views' depth maps."""
    points = points_to_utm(depth.unproject(depths, matrices), origin, area)
    fused = robust.mad_fuse(surfaces(points, area, ["view"]), ["row", "col"], "z")
    return raster.median3x3(fused, area.rows, area.cols).join(fused.select("row", "col", "n"), ["row", "col"])


def surface_points(dsm: DataFrame, area: Area) -> DataFrame:
    """(x, y, z, level): UTM points of the valued cells, with the row of the height colour table."""
    east, north = raster.cell_corner(F.col("row"), F.col("col"), area.ul_e, area.ul_n, area.res, area.res)
    lo, hi = robust.global_percentiles(dsm, "z", [0.01, 0.99])
    return dsm.select(east.alias("x"), north.alias("y"), "z", image.color_index(F.col("z"), F.lit(lo).cast("double"), F.lit(hi).cast("double")).alias("level"))


def run_steps(spark: SparkSession, steps: dict[str, Callable[[], object]], wanted: dict[str, bool]) -> DataFrame:
    """Runs the wanted steps in their order; (step, has_run, minutes) of all."""
    log = []
    for name, step in steps.items():
        began = time.time()
        if wanted.get(name, False):
            step()
        log.append((name, bool(wanted.get(name, False)), (time.time() - began) / 60))
    return spark.createDataFrame(log, "step string, has_run boolean, minutes double")


def height_of(df: DataFrame, value: Column) -> DataFrame:
    """Void ratio, least and largest height: what is reported of a surface."""
    return df.agg(F.count(value).alias("n"), F.min(value).alias("z_min"), F.max(value).alias("z_max"))
