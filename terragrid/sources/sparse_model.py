"""Sparse model files: cameras, images and points, as text and as little-endian binary."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as sc
from .files import parsed, read_files

_MODELS = {m[0]: m for m in sc.CAMERA_MODELS}
_BY_NAME = {m[1]: m for m in sc.CAMERA_MODELS}


class Bytes:
    """A reader of fixed-size values."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, form: str):
        out = struct.unpack_from("<" + form, self.raw, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def name(self) -> str:
        end = self.raw.index(b"\0", self.at)
        out = self.raw[self.at : end].decode()
        self.at = end + 1
        return out


def cameras_binary(_: str, raw: bytes):
    b = Bytes(raw)
    for _ in range(b.take("Q")[0]):
        camera_id, model, w, h = b.take("iiQQ")
        _, name, n = _MODELS[model]
        yield {"camera_id": camera_id, "model": name, "width": w, "height": h, "params": list(b.take(f"{n}d"))}


def images_binary(_: str, raw: bytes):
    b = Bytes(raw)
    for _ in range(b.take("Q")[0]):
        image_id, *pose, camera_id = b.take("i7di")
        name = b.name()
        n = b.take("Q")[0]
        flat = [b.take("ddq") for _ in range(n)]
        yield {"image_id": image_id, "q": pose[:4], "t": pose[4:], "camera_id": camera_id, "name": name, "points2d": [{"x": x, "y": y, "point3d_id": p} for x, y, p in flat]}


def points_binary(_: str, raw: bytes):
    b = Bytes(raw)
    for _ in range(b.take("Q")[0]):
        pid, x, y, z, red, green, blue, error = b.take("QdddBBBd")
        n = b.take("Q")[0]
        flat = b.take(f"{2 * n}i")
        yield {"point3d_id": pid, "x": x, "y": y, "z": z, "r": red, "g": green, "b": blue, "error": error, "track": [{"image_id": i, "point2d_idx": j} for i, j in zip(flat[::2], flat[1::2])]}


def images_text(_: str, raw: bytes):
    """A record is a pose line and a line of x, y, point triples, which may be empty."""
    lines = iter([s for s in raw.decode().split("\n") if not s.startswith("#")])
    for line in lines:
        if not line.strip():
            continue
        f = line.split()
        second = next(lines, None)
        if second is None:
            raise ValueError(f"no second line for image {f[0]}")
        flat = second.split()
        if len(flat) % 3:
            raise ValueError(f"pixels of image {f[0]} aren't triples")
        points = [{"x": float(x), "y": float(y), "point3d_id": int(p)} for x, y, p in zip(flat[::3], flat[1::3], flat[2::3])]
        yield {"image_id": int(f[0]), "q": [float(x) for x in f[1:5]], "t": [float(x) for x in f[5:8]], "camera_id": int(f[8]), "name": f[9], "points2d": points}


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    return lines.select(F.split(F.trim("value"), r"\s+").alias("f"))


def read_cameras(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    if path.endswith(".bin"):
        return parsed(read_files(spark, path), cameras_binary, sc.SPARSE_CAMERAS, errors)
    f = F.col("f")
    params = F.transform(F.slice(f, 5, F.size(f) - 4), lambda x: x.cast("double"))
    return _fields(spark, path).select(f[0].cast("int").alias("camera_id"), f[1].alias("model"), f[2].cast("long").alias("width"), f[3].cast("long").alias("height"), params.alias("params"))


def read_images(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    return parsed(read_files(spark, path), images_binary if path.endswith(".bin") else images_text, sc.SPARSE_IMAGES, errors)


def read_points(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    if path.endswith(".bin"):
        return parsed(read_files(spark, path), points_binary, sc.SPARSE_POINTS, errors)
    f = F.col("f")
    pair = lambda i: F.struct(f[8 + 2 * i].cast("int").alias("image_id"), f[9 + 2 * i].cast("int").alias("point2d_idx"))
    n = ((F.size(f) - 8) / 2).cast("int")
    track = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast("array<struct<image_id: int, point2d_idx: int>>"))
    whole = [f[i].cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))] + [f[i].cast("smallint").alias(c) for i, c in ((4, "r"), (5, "g"), (6, "b"))]
    return _fields(spark, path).select(f[0].cast("long").alias("point3d_id"), *whole, f[7].cast("double").alias("error"), track.alias("track"))


def read_model(spark: SparkSession, folder: str, ext: str = ".txt") -> tuple[DataFrame, DataFrame, DataFrame]:
    """cameras, images and points of a folder."""
    return tuple(f(spark, f"{folder}/{n}{ext}") for f, n in ((read_cameras, "cameras"), (read_images, "images"), (read_points, "points3D")))


def point_lines(points: DataFrame) -> DataFrame:
    """value: a line of points3D.txt for each row."""
    track = F.array_join(F.transform("track", lambda o: F.concat_ws(" ", o["image_id"].cast("string"), o["point2d_idx"].cast("string"))), " ")
    return points.select(F.rtrim(_joined(*[F.col(c).cast("string") for c in ("point3d_id", "x", "y", "z", "r", "g", "b", "error")], track)).alias("value"))


_CODES = {name: code for code, name, _ in sc.CAMERA_MODELS}


def _camera_bytes(r) -> bytes:
    return struct.pack(f"<iiQQ{len(r['params'])}d", r["camera_id"], _CODES[r["model"]], r["width"], r["height"], *r["params"])


def _image_bytes(r) -> bytes:
    head = struct.pack("<i7di", r["image_id"], *r["q"], *r["t"], r["camera_id"]) + r["name"].encode() + b"\0"
    return head + struct.pack("<Q", len(r["points2d"])) + b"".join(struct.pack("<ddq", p["x"], p["y"], p["point3d_id"]) for p in r["points2d"])


def _point_bytes(r) -> bytes:
    flat = [v for o in r["track"] for v in (o["image_id"], o["point2d_idx"])]
    return struct.pack("<QdddBBBdQ", r["point3d_id"], r["x"], r["y"], r["z"], r["r"], r["g"], r["b"], r["error"], len(r["track"])) + struct.pack(f"<{len(flat)}i", *flat)


def binary_files(rows: DataFrame, kind: str) -> DataFrame:
    """(path, content): a little-endian file of cameras, images or points3D for each partition. The header has the
    number of records, so a partition is gathered first: partition by size."""
    record = {"cameras": _camera_bytes, "images": _image_bytes, "points3D": _point_bytes}[kind]

    def run(batches):
        from pyspark import TaskContext

        parts = [record(r) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([f"{kind}-{TaskContext.get().partitionId():05d}.bin"]), pa.array([struct.pack("<Q", len(parts)) + b"".join(parts)], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _joined(*cols):
    return F.concat_ws(" ", *cols)


def camera_lines(cameras: DataFrame) -> DataFrame:
    """value: a line of cameras.txt for each row."""
    return cameras.select(_joined(F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), F.array_join(F.transform("params", lambda x: x.cast("string")), " ")).alias("value"))


def image_lines(images: DataFrame) -> DataFrame:
    """value: the two lines of images.txt for each row, in one value."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    pixels = F.array_join(F.transform("points2d", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["point3d_id"].cast("string"))), " ")
    return images.select(F.concat(_joined(F.col("image_id").cast("string"), text("q"), text("t"), F.col("camera_id").cast("string"), "name"), F.lit("\n"), pixels).alias("value"))


def write_init_model(cameras: DataFrame, images: DataFrame, folder: str) -> None:
    """cameras, images (without pixels), an empty points3D and name-to-id lines, as text."""
    camera_lines(cameras).write.text(f"{folder}/cameras")
    empty = images.withColumn("points2d", F.array().cast("array<struct<x: double, y: double, point3d_id: long>>"))
    image_lines(empty).write.text(f"{folder}/images")
    images.where("false").select("name").write.text(f"{folder}/points3D")
    images.select(F.concat_ws(" ", "name", F.col("image_id").cast("string"))).write.text(f"{folder}/img_name2id")


def write_extracted(obs: DataFrame, camera_dict: DataFrame, points: DataFrame, folder: str) -> None:
    """Cameras, tracks and keypoints as JSON and points as "%.6f" text."""
    from ..operators import sparse

    camera_dict.write.json(f"{folder}/cameras")
    points.select(F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("value")).write.text(f"{folder}/points")
    sparse.track_pixels(obs).write.json(f"{folder}/tracks")
    sparse.view_keypoints(obs).write.json(f"{folder}/keypoints")
