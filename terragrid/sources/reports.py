"""Text and JSON outputs: depth ranges, dense-matching configuration, camera reports, cameras and their boxes, image
metadata, per-view inspection, principal points, run times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEIGHBOURS = 20


def depth_range_lines(ranges: DataFrame, key: str = "img") -> DataFrame:
    """value: "name min max", sorted by name; views without a depth get the sentinel -1e20 twice."""
    text = lambda c: F.coalesce(F.col(c), F.lit(-1e20)).cast("string")
    return ranges.orderBy(key).select(F.concat_ws(" ", key, text("depth_min"), text("depth_max")).alias("value"))


def write_depth_ranges(got: dict[str, DataFrame], views: DataFrame, folder: str, key: str = "img") -> None:
    """raw, reparametrised, last rows, reference plane and common ranges; views without any range too. got: of ``depth.reparametrised``."""
    from ..operators.depth import common_range

    for name in ("raw", "reparam"):
        depth_range_lines(views.join(got[name], key, "left"), key).write.text(f"{folder}/{name}")
    last = got["last_rows"].orderBy(key)
    last.select(F.concat_ws(" ", key, F.array_join(F.transform("last_row", lambda x: x.cast("string")), " ")).alias("value")).write.text(f"{folder}/last_rows")
    last.select(F.concat_ws(" ", key, F.array_join(F.transform(F.slice("last_row", 3, 2), lambda x: (x / F.col("last_row")[2]).cast("string")), " ")).alias("value")).write.text(f"{folder}/reference_plane")
    seen = got["last_rows"].select(key)
    depth_range_lines(seen.join(F.broadcast(common_range(got["obs"]))), key).write.text(f"{folder}/common")


def matching_config(images: DataFrame, key: str = "img") -> DataFrame:
    """value: an image's name and the line that asks for its neighbours."""
    return images.orderBy(key).select(F.concat(F.col(key), F.lit(f"\n__auto__, {NEIGHBOURS}")).alias("value"))


def fusion_list(images: DataFrame, key: str = "img") -> DataFrame:
    return images.orderBy(key).select(F.col(key).alias("value"))


def write_camera_report(errors: DataFrame, folder: str) -> None:
    """Seven columns: image and six errors."""
    errors.orderBy(errors.columns[0]).coalesce(1).write.csv(folder, header=True)


def write_matches(matches: DataFrame, folder: str) -> None:
    """(src, dst, n) as a file of its own for each source view."""
    matches.write.partitionBy("src").csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    """A JSON object a line for each row: metadata, cameras, boxes, the area."""
    df.write.option("ignoreNullFields", "false").json(folder)


def camera_json(cameras: DataFrame, key: str = "img", params: str = "params") -> DataFrame:
    """value: a JSON object {image: [width, height, parameters]} a row, which Spark's map reader gives back as one."""
    return cameras.select(F.to_json(F.create_map(F.col(key), F.col(params))).alias("value"))


def box_of(points: DataFrame, names: list[str]) -> DataFrame:
    """One row: <name>_min and <name>_max of each column, the box around the samples that the cameras were fitted to."""
    return points.agg(*[f(n).alias(f"{n}_{s}") for n in names for f, s in ((F.min, "min"), (F.max, "max"))])


def write_cameras(affine: DataFrame, perspective: DataFrame, samples: DataFrame, folder: str) -> None:
    """The cameras of all images and their boxes: affine by latitude, longitude and altitude, perspective by ENU.

    affine, perspective: (img, params); samples: (lat, lon, alt, xx, yy, zz) of the lattice."""
    camera_json(affine).write.text(f"{folder}/affine_latlonalt")
    camera_json(perspective).write.text(f"{folder}/perspective_enu")
    write_json(box_of(samples, ["lat", "lon", "alt"]), f"{folder}/bbx_latlonalt")
    write_json(box_of(samples, ["xx", "yy", "zz"]), f"{folder}/bbx_enu")


def image_manifest(metas: DataFrame, folder: str) -> DataFrame:
    """(png, json) of cropped images, by name: where each one's picture and metadata are."""
    return metas.orderBy("name").select(F.concat(F.lit(f"{folder}/"), "name", F.lit(".png")).alias("png"), F.concat(F.lit(f"{folder}/"), "name", F.lit(".json")).alias("json"))


def write_metas(metas: DataFrame, folder: str) -> None:
    """Each image's metadata as JSON (times in ISO form), and the manifest of the images."""
    write_json(metas.withColumn("capTime", F.date_format("capTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), f"{folder}/metas")
    write_json(image_manifest(metas, folder), f"{folder}/manifest")


def write_principal_points(delta: DataFrame, folder: str, key: str = "img") -> None:
    """(img, d_cx, d_cy) as CSV, by image: how far the adjustment moved the principal point."""
    delta.orderBy(key).select(F.col(key).alias("img_name"), F.col("d_cx").alias("delta_cx"), F.col("d_cy").alias("delta_cy")).write.csv(folder, header=True)


def keypoint_lines(stats: DataFrame, key: str = "img") -> DataFrame:
    """value: image, size, number of key points, mean and median error and track length, in four decimals. stats: what
    ``sparse.view_stats`` gives, with w and h."""
    number = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    text = [F.col(c).cast("string") for c in (key, "w", "h", "n")] + [number(c) for c in ("mean_err", "median_err", "mean_len", "median_len")]
    return stats.orderBy(key).select(F.concat_ws(", ", *text).alias("value"))


def view_range_lines(ranges: DataFrame, key: str = "img") -> DataFrame:
    """value: image, least and largest depth (first and last percentile)."""
    return ranges.orderBy(key).select(F.concat_ws(", ", key, F.col("depth_min").cast("string"), F.col("depth_max").cast("string")).alias("value"))


def write_inspection(stats: DataFrame, ranges: DataFrame, matches: DataFrame, folder: str, key: str = "img") -> None:
    """Key points and depth ranges of each view, and the matches of each view with all others."""
    keypoint_lines(stats, key).write.text(f"{folder}/keypoints")
    view_range_lines(ranges, key).write.text(f"{folder}/depth_ranges")
    write_matches(matches, f"{folder}/matches")


def runtime_lines(steps: DataFrame) -> DataFrame:
    """value: each step with its state and minutes in the order it has, then the total. steps: (step, has_run, minutes), which a run has a few of."""
    numbered = steps.withColumn("i", F.monotonically_increasing_id())
    each = numbered.select("i", F.when(F.col("has_run"), F.concat_ws(", ", "step", F.lit("success"), F.col("minutes").cast("string"))).otherwise(F.concat_ws(", ", "step", F.lit("skipped"))).alias("value"))
    total = steps.agg(F.concat(F.lit("total: "), F.coalesce(F.sum("minutes"), F.lit(0.0)).cast("string"), F.lit(" minutes")).alias("value"))
    return each.unionByName(total.select(F.lit(2**62).alias("i"), "value")).orderBy("i").select("value")


def write_runtime(steps: DataFrame, folder: str) -> None:
    runtime_lines(steps).coalesce(1).write.text(folder)
