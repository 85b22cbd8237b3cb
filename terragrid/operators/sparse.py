"""Sparse models: cameras, images, tracks, match graphs and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as la
from ..functions.image import pair_of
from .robust import summaries


def camera_dict(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """(img, camera): size, parameters, quaternion and translation in one array for each image.

    Cameras are fewer than images and unbounded in number, so the planner picks the join."""
    joined = images.join(cameras, "camera_id")
    size = F.array(F.col("width").cast("double"), F.col("height").cast("double"))
    return joined.select(F.col("name").alias("img"), F.concat(size, "params", "q", "t").alias("camera"))


def camera_columns(camera: Column) -> dict:
    """K, R, t and size of a 14-entry camera array (w, h, fx, fy, cx, cy, s, q, t)."""
    k = la.intrinsics(*[camera[i] for i in range(2, 7)])
    r = la.quat_to_rot([camera[i] for i in range(7, 11)])
    return {"w": camera[0], "h": camera[1], "k": k, "r": r, "t": [camera[i] for i in range(11, 14)]}


def camera_matrices(cameras: DataFrame, camera: str = "camera") -> DataFrame:
    """``cameras`` with w, h, k (9), r (9) and t (3): each camera's matrices once, before any join to what it sees."""
    c = camera_columns(F.col(camera))
    flat = lambda m: F.array(*[x for r in m for x in r])
    return cameras.withColumns({"w": c["w"], "h": c["h"], "k": flat(c["k"]), "r": flat(c["r"]), "t": F.array(*c["t"])})


def matrix(name: str, rows: int = 3, cols: int = 3) -> la.Matrix:
    """An array column as a matrix."""
    return [[F.col(name)[i * cols + j] for j in range(cols)] for i in range(rows)]


def observations(points: DataFrame, images: DataFrame) -> DataFrame:
    """A row for each entry of each track: point, image name, pixel, and whether the image refers back to the point.

    Tracks explode; pixels explode with their index; both meet on (image, index)."""
    seen = points.select("point3d_id", "x", "y", "z", "error", F.size("track").alias("track_len"), F.posexplode("track").alias("place", "o"))
    seen = seen.select("point3d_id", "x", "y", "z", "error", "track_len", "place", F.col("o.image_id").alias("image_id"), F.col("o.point2d_idx").alias("idx"))
    pixels = images.select("image_id", F.col("name").alias("img"), F.posexplode("points2d").alias("idx", "p"))
    pixels = pixels.select("image_id", "img", "idx", F.col("p.x").alias("u"), F.col("p.y").alias("v"), F.col("p.point3d_id").alias("back"))
    return seen.join(pixels, ["image_id", "idx"]).withColumn("consistent", F.col("back") == F.col("point3d_id")).drop("back")


def track_pixels(obs: DataFrame, key: str = "point3d_id") -> DataFrame:
    """(key, pixels): each track's pixels sorted by image name."""
    return obs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("img", "u", "v"))).alias("pixels"))


def view_keypoints(obs: DataFrame) -> DataFrame:
    """(img, keypoints): pixel, position and track length of what each image sees, sorted."""
    return obs.groupBy("img").agg(F.sort_array(F.collect_list(F.struct("u", "v", "x", "y", "z", "track_len"))).alias("keypoints"))


def reprojection(obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """obs with depth and err: distance of the pixel to the projected point. cameras: (img, camera array)."""
    both = obs.join(camera_matrices(cameras).select("img", "k", "r", "t"), "img")
    local = [x + F.col("t")[i] for i, x in enumerate(la.matvec(matrix("r"), [F.col("x"), F.col("y"), F.col("z")]))]
    u, v, w = la.matvec(matrix("k"), local)
    err = F.sqrt(F.pow(F.col("u") - F.try_divide(u, w), 2) + F.pow(F.col("v") - F.try_divide(v, w), 2))
    return both.withColumns({"depth": local[2], "err": err}).drop("k", "r", "t")


def view_stats(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and median of error and track length."""
    out = summaries(obs, keys, {"median_err": "err", "median_len": "track_len"}, [F.count(F.lit(1)).alias("n"), F.avg("err").alias("mean_err"), F.avg("track_len").alias("mean_len")])
    return out.select(*keys, "n", "mean_err", "median_err", "mean_len", "median_len")


def track_stats(points: DataFrame) -> DataFrame:
    """One row: least, mean, median and largest error and track length."""
    values = ("error", "track_len")
    out = summaries(points, [], {f"median_{v}": v for v in values}, [f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])
    return out.select(*[f"{n}_{v}" for v in values for n in ("min", "mean", "median", "max")])


def camera_error(rows: DataFrame, keys: list[str], proj: Column, inverse: Column) -> DataFrame:
    """Mean, median and largest projection and inverse-projection error."""
    names = ("proj", "inv")
    both = rows.select(*keys, proj.alias("proj"), inverse.alias("inv"))
    out = summaries(both, keys, {f"median_{n}": n for n in names}, [f(n).alias(f"{a}_{n}") for n in names for a, f in (("mean", F.avg), ("max", F.max))])
    return out.select(*keys, *[f"{a}_{n}" for n in names for a in ("mean", "median", "max")])


def projection_errors(k: la.Matrix, r: la.Matrix, t: la.Vector, xyz: la.Vector, col: Column, row: Column) -> tuple[Column, Column]:
    """Pixel distance of the projected point, and distance of the point to the pixel's ray."""
    local = [a + b for a, b in zip(la.matvec(r, xyz), t)]
    u, v, w = la.matvec(k, local)
    proj = F.sqrt(F.pow(F.try_divide(u, w) - col, 2) + F.pow(F.try_divide(v, w) - row, 2))
    ray = la.matvec(la.inv3(k), [col, row, F.lit(1.0)])
    scale = F.try_divide(la.dot(local, ray), la.dot(ray, ray))
    return proj, la.norm([a * scale - b for a, b in zip(ray, local)])


def camera_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(img, d_cx, d_cy) of (img, cx, cy) before and after an adjustment."""
    b = after.select("img", F.col("cx").alias("cx2"), F.col("cy").alias("cy2"))
    return before.join(b, "img").select("img", (F.col("cx2") - F.col("cx")).alias("d_cx"), (F.col("cy2") - F.col("cy")).alias("d_cy"))


def strict_lookup(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The equi-join, and the rows of ``left`` that have no partner (an error to whoever needs all)."""
    return left.join(right, key), left.join(right, key, "left_anti")


def match_graph(pairs: DataFrame) -> DataFrame:
    """(src, dst, n): both directions of pairs (pair_id, n) with matches; n adds up over repeated pairs."""
    a, b = pair_of(F.col("pair_id"))
    edges = pairs.where(F.col("n") >= 1).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = edges.select(F.col("a").eqNullSafe(F.col("b")).alias("self"), F.stack(F.lit(2), "a", "b", "n", F.lit(False), "b", "a", "n", F.lit(True)).alias("src", "dst", "n", "back"))
    return both.where("NOT (self AND back)").select("src", "dst", F.when(F.col("self"), F.col("n") * 2).otherwise(F.col("n")).alias("n"))


def match_matrix(nodes: DataFrame, graph: DataFrame, key: str, pairs_a_task: int = 1 << 23) -> DataFrame:
    """Every ordered pair of different nodes with its number of matches, 0 by default.

    The result has a row for each ordered pair of images by definition, but only edges are shuffled and sorted for it:
    nodes are numbered in the order of their keys, and an edge comes out with the zeros up to the next edge of its
    node, an edge at -1 standing before the first. Tasks hold the sorted nodes, the square root of the result.
    ``pairs_a_task`` only sets how many tasks there are."""
    nodes = nodes.select(F.col(key).alias("k")).where("k IS NOT NULL")
    total = nodes.count()
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * total // pairs_a_task))
    every = nodes.agg(F.sort_array(F.collect_list("k")).alias("every"))
    place = lambda at, k: F.broadcast(every.select(F.posexplode("every").alias(at, k)))
    edges = graph.join(place("i", "src"), "src").join(place("j", "dst"), "dst").select("i", "j", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    starts = every.select(F.posexplode("every").alias("i", "k")).select("i", F.lit(-1).alias("j"), F.lit(0).cast("long").alias("n"))
    rows = edges.unionByName(starts).repartition(tasks, "i")
    rows = rows.withColumn("next", F.lead("j").over(Window.partitionBy("i").orderBy("j"))).crossJoin(F.broadcast(every))
    run = F.sequence("j", F.greatest(F.coalesce("next", F.size("every")) - 1, "j"))
    out = rows.select("i", "j", "n", "every", F.explode(run).alias("at"))
    return out.select(F.get("every", F.col("i")).alias("src"), F.get("every", F.col("at")).alias("dst"), F.when(F.col("at") == F.col("j"), F.col("n")).otherwise(0).alias("n")).where("src != dst")


def pairwise_angles(vectors: DataFrame, key: str, dims: int, vector: str, mirrored: bool = False) -> DataFrame:
    """(i, j, angle) in degrees for i < j; mirrored: with both orders and a zero diagonal."""
    parts = lambda c: [F.col(c)[k].cast("double") for k in range(dims)]
    a = vectors.select(F.col(key).alias("i"), F.col(vector).alias("a"))
    b = vectors.select(F.col(key).alias("j"), F.col(vector).alias("b"))
    out = a.join(b, F.col("i") < F.col("j")).select("i", "j", la.angle_degrees(parts("a"), parts("b")).alias("angle"))
    if mirrored:
        diagonal = vectors.select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(0.0).alias("angle"))
        out = out.unionByName(out.select(F.col("j").alias("i"), F.col("i").alias("j"), "angle")).unionByName(diagonal)
    return out


def field_of_view(k: la.Matrix, width: Column, height: Column) -> tuple[Column, Column]:
    """Left-right and up-down angle in degrees."""
    inv = la.inv3(k)
    ray = lambda x, y: la.matvec(inv, [x, y, F.lit(1.0)])
    zero = F.lit(0.0)
    return la.angle_degrees(ray(zero, height / 2), ray(width, height / 2)), la.angle_degrees(ray(width / 2, zero), ray(width / 2, height))
