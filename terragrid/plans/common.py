"""Registration of queries, and the tables they stand on.

The workload's own inputs (images, cameras, tracks, depth maps) have analogues in the star schema: each query says in its
body which columns play which part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(col, digits: int = 6):
    """Rounded; adding zero makes a negative zero positive, as it prints otherwise than zero."""
    return F.round(col, digits) + F.lit(0.0)


def long(col):
    return col.cast("long")


#: Nations as perspective cameras: size, intrinsics, quaternion, translation.
CAMERA_SQL = """
    cam0 AS (SELECT n_nationkey AS k, n_name AS img, (640 + n_nationkey)::DOUBLE AS w, (480 + n_nationkey)::DOUBLE AS h,
                    1000.0::DOUBLE + 10 * n_nationkey AS fx, 1000.0::DOUBLE + 7 * n_nationkey AS fy, 320.0::DOUBLE + n_nationkey AS cx, 240.0::DOUBLE - n_nationkey AS cy,
                    n_nationkey / 10.0::DOUBLE AS s, 1.0::DOUBLE AS qw, n_nationkey / 100.0::DOUBLE AS qx, n_nationkey / 50.0::DOUBLE AS qy, -n_nationkey / 80.0::DOUBLE AS qz,
                    n_nationkey::DOUBLE AS tx, -2.0::DOUBLE * n_nationkey AS ty, 100.0::DOUBLE + n_nationkey AS tz FROM nation),
    cam1 AS (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS qn FROM cam0),
    cam2 AS (SELECT * REPLACE (qw / qn AS qw, qx / qn AS qx, qy / qn AS qy, qz / qn AS qz) FROM cam1),
    cam AS (SELECT *, 1 - 2 * (qy * qy + qz * qz) AS r11, 2 * (qx * qy - qw * qz) AS r12, 2 * (qx * qz + qw * qy) AS r13,
                   2 * (qx * qy + qw * qz) AS r21, 1 - 2 * (qx * qx + qz * qz) AS r22, 2 * (qy * qz - qw * qx) AS r23,
                   2 * (qx * qz - qw * qy) AS r31, 2 * (qy * qz + qw * qx) AS r32, 1 - 2 * (qx * qx + qy * qy) AS r33 FROM cam2)"""


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, img, camera array) of the nations."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("double")
    parts = [640 + k, 480 + k, 1000 + 10 * k, 1000 + 7 * k, 320 + k, 240 - k, k / 10, F.lit(1.0), k / 100, k / 50, -k / 80, k, -2 * k, 100 + k]
    return n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("img"), F.array(*parts).alias("camera"))
