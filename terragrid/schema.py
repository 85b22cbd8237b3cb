"""Schemas of the data model, and the catalog of camera models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RPC = "struct<rowNum: array<double>, rowDen: array<double>, colNum: array<double>, colDen: array<double>, rowOff: double, rowScale: double, colOff: double, colScale: double, latOff: double, latScale: double, lonOff: double, lonScale: double, altOff: double, altScale: double>"
IMAGE_META = f"name string, rpc {RPC}, width int, height int, capTime timestamp, sunAzim double, sunElev double, satAzim double, satElev double, cloudCover double, sensor_id string"
AOI = "zone_number int, hemisphere string, ul_easting double, ul_northing double, lr_easting double, lr_northing double, width double, height double, lat_min double, lat_max double, lon_min double, lon_max double, alt_min double, alt_max double"
CAMERA = "img string, w int, h int, fx double, fy double, cx double, cy double, s double, q array<double>, t array<double>"
SPARSE_CAMERAS = "camera_id int, model string, width long, height long, params array<double>"
SPARSE_IMAGES = "image_id int, q array<double>, t array<double>, camera_id int, name string, points2d array<struct<x: double, y: double, point3d_id: long>>"
SPARSE_POINTS = "point3d_id long, x double, y double, z double, r smallint, g smallint, b smallint, error double, track array<struct<image_id: int, point2d_idx: int>>"
DEPTH = "view string, row int, col int, depth float"
INV_PROJ = "img string, m array<double>"
POINTS = "x double, y double, z double, red smallint, green smallint, blue smallint"
DSM = "row int, col int, z double"
DSM_STACK = "view string, row int, col int, z double"
OBSERVATION = "img string, u double, v double, x double, y double, z double, track_len int"
STEP_LOG = "step string, has_run boolean, minutes double"

# fixed values: identifier, name and number of parameters of each camera model in sparse model files
CAMERA_MODELS = (
    (0, "SIMPLE_PINHOLE", 3),
    (1, "PINHOLE", 4),
    (2, "SIMPLE_RADIAL", 4),
    (3, "RADIAL", 5),
    (4, "OPENCV", 8),
    (5, "OPENCV_FISHEYE", 8),
    (6, "FULL_OPENCV", 12),
    (7, "FOV", 5),
    (8, "SIMPLE_RADIAL_FISHEYE", 4),
    (9, "RADIAL_FISHEYE", 5),
    (10, "THIN_PRISM_FISHEYE", 12),
    (11, "PERSPECTIVE", 5),
)


def camera_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMERA_MODELS, "model_id int, model string, num_params int")
