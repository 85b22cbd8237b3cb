"""A minimal GeoTIFF codec: one band of float32, uncompressed strips, UTM on WGS84."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import parsed, read_files

NODATA = -10000.0
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}


@dataclass(frozen=True)
class Georef:
    ul_e: float
    ul_n: float
    e_res: float
    n_res: float
    zone: int
    south: bool


def encode(z: np.ndarray, ref: Georef, nodata: float = NODATA) -> bytes:
    """NaN becomes the no-data value."""
    rows, cols = z.shape
    data = np.where(np.isnan(z), nodata, z).astype("<f4").tobytes()
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, (32700 if ref.south else 32600) + ref.zone)
    tags = [
        (256, 4, (cols,)), (257, 4, (rows,)), (258, 3, (32,)), (259, 3, (1,)), (262, 3, (1,)), (273, 4, (8,)), (277, 3, (1,)), (278, 4, (rows,)), (279, 4, (len(data),)), (339, 3, (3,)),
        (33550, 12, (ref.e_res, ref.n_res, 0.0)), (33922, 12, (0.0, 0.0, 0.0, ref.ul_e, ref.ul_n, 0.0)), (34735, 3, keys), (42113, 2, f"{nodata:g}\0".encode()),
    ]
    at = 8 + len(data) + len(data) % 2
    entries, extra = b"", b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, kind, v in tags:
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{_SIZES[kind]}", *v)
        n = len(v)
        if len(raw) <= 4:
            entries += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, n, base + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return struct.pack("<2sHI", b"II", 42, at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def decode(raw: bytes) -> tuple[np.ndarray, Georef]:
    """The band with NaN for no data, and its place."""
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    magic, at = struct.unpack_from(order + "HI", raw, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    tags = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        size = struct.calcsize(_SIZES.get(kind, "B")) * n
        off = at + 10 + 12 * i
        if size > 4:
            off = struct.unpack_from(order + "I", raw, off)[0]
        tags[tag] = raw[off : off + n] if kind == 2 else struct.unpack_from(f"{order}{n}{_SIZES.get(kind, 'B')}" if kind != 5 else f"{order}{2 * n}I", raw, off)
    if tags.get(277, (1,))[0] != 1 or tags.get(259, (1,))[0] != 1 or tags[258][0] != 32 or tags.get(339, (1,))[0] != 3:
        raise ValueError("one uncompressed band of 32-bit floats is what this reads")
    cols, rows = tags[256][0], tags[257][0]
    data = b"".join(raw[o : o + n] for o, n in zip(tags[273], tags[279]))
    z = np.frombuffer(data, order + "f4", rows * cols).reshape(rows, cols).astype(np.float64)
    if 42113 in tags:
        nodata = float(tags[42113].rstrip(b"\0 "))
        z = np.where(np.isclose(z, nodata), np.nan, z)
    keys = tags.get(34735, ())
    code = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == 3072), 0)
    scale, tie = tags[33550], tags[33922]
    return z, Georef(tie[3], tie[4], scale[0], scale[1], code % 100, code >= 32700)


def _rows(_: str, raw: bytes):
    z, _ = decode(raw)
    row, col = np.nonzero(~np.isnan(z))
    yield pa.table([pa.array(row.astype("i4")), pa.array(col.astype("i4")), pa.array(z[row, col])], names=["row", "col", "z"])


def _refs(_: str, raw: bytes):
    z, g = decode(raw)
    yield {"ul_e": g.ul_e, "ul_n": g.ul_n, "lr_e": g.ul_e + z.shape[1] * g.e_res, "lr_n": g.ul_n - z.shape[0] * g.n_res, "e_res": g.e_res, "n_res": g.n_res, "zone": g.zone, "hemisphere": "S" if g.south else "N", "n_rows": z.shape[0], "n_cols": z.shape[1]}


def read_dsm(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    """(row, col, z) of the valued cells."""
    return parsed(read_files(spark, path), _rows, "row int, col int, z double", errors)


def read_georef(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    return parsed(read_files(spark, path), _refs, "ul_e double, ul_n double, lr_e double, lr_n double, e_res double, n_res double, zone int, hemisphere string, n_rows int, n_cols int", errors)


def dsm_files(dsm: DataFrame, name: str, rows: int, cols: int, ref: Georef) -> DataFrame:
    """(path, content) of one file, by the task that gathers the raster: for surfaces that fit a task."""

    def run(pdf):
        z = np.full((rows, cols), np.nan)
        z[pdf["row"], pdf["col"]] = pdf["z"]
        return pd.DataFrame({"path": [name], "content": [encode(z, ref)]})

    return dsm.select("row", "col", "z", F.lit(0).alias("one")).groupBy("one").applyInPandas(run, "path string, content binary")


def dsm_strips(dsm: DataFrame, stem: str, rows: int, cols: int, ref: Georef, strip: int = 1024) -> DataFrame:
    """(path, content) of a file for every ``strip`` rows of the surface, each with its own place: a task holds one strip.

    Strips without a valued cell are written too, so that the files cover the area. ``read_strips`` reads them as one surface."""
    high = min(strip, rows)
    every = dsm.sparkSession.range((rows + high - 1) // high).select(F.col("id").cast("int").alias("s"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("double").alias("z"))
    cells = dsm.select(F.floor(F.col("row") / high).cast("int").alias("s"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("z").cast("double").alias("z"))

    def run(pdf):
        s = int(pdf["s"].iloc[0])
        z = np.full((min(high, rows - s * high), cols), np.nan)
        own = pdf[pdf["row"].notna()]
        z[own["row"].astype(int) - s * high, own["col"].astype(int)] = own["z"]
        place = Georef(ref.ul_e, ref.ul_n - s * high * ref.n_res, ref.e_res, ref.n_res, ref.zone, ref.south)
        return pd.DataFrame({"path": [f"{stem}-{s:05d}.tif"], "content": [encode(z, place)]})

    return cells.unionByName(every).groupBy("s").applyInPandas(run, "path string, content binary")


def read_strips(spark: SparkSession, path: str, ref: Georef, errors: str = "raise") -> DataFrame:
    """(row, col, z) of the valued cells of all files, in rows and columns of the raster that ``ref`` begins."""

    def rows(_, raw):
        z, g = decode(raw)
        row, col = np.nonzero(~np.isnan(z))
        down, right = round((ref.ul_n - g.ul_n) / ref.n_res), round((g.ul_e - ref.ul_e) / ref.e_res)
        yield pa.table([pa.array((row + down).astype("i4")), pa.array((col + right).astype("i4")), pa.array(z[row, col])], names=["row", "col", "z"])

    return parsed(read_files(spark, path), rows, "row int, col int, z double", errors)
