"""Pictures (PNG, JPEG) as pixel relations, by Spark's image source, and pixel relations as PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(view, row, col, band, value) of the pixels of all pictures in a folder; band 0 is blue in colour pictures, as the source gives them.

    Files that are no pictures are left out by the source."""
    pics = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches):
        for pdf in batches:
            for name, h, w, c, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                a = np.frombuffer(data, np.uint8).reshape(h, w, c)
                for i in range(0, h, 256):  # some rows of the picture at a time
                    part = a[i : i + 256]
                    row, col, band = np.indices(part.shape).reshape(3, -1)
                    yield pd.DataFrame({"view": name, "row": row + i, "col": col, "band": band, "value": part.ravel().astype("i2")})

    out = pics.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "view string, row int, col int, band int, value smallint")
    return out.withColumn("view", F.substring_index("view", "/", -1))


def read_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """White-space separated numbers under a "#" header: a double column for each name."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return rows.select(*[F.get(f, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])


def png(a: np.ndarray) -> bytes:
    """An 8-bit PNG of a (rows, cols) grey or (rows, cols, 3) red, green and blue array."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.ascontiguousarray(a, np.uint8).reshape(a.shape[0], -1)
    data = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def picture_files(pixels: DataFrame, rows: int, cols: int, key: str = "view", value: str = "value", colours: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(path, content): a PNG named after each view, of (key, row, col, value) with levels from 0; a picture is one task.

    ``colours`` maps levels to red, green and blue; without it levels are grey. Pixels that are void (masked) are black."""

    def run(pdf):
        level = np.zeros((rows, cols), np.int64)
        there = np.zeros((rows, cols), bool)
        own = pdf[pdf["v"].notna()]
        level[own["row"], own["col"]] = own["v"].astype(int)
        there[own["row"], own["col"]] = True
        if colours is None:
            picture = np.where(there, level, 0).clip(0, 255)
        else:
            picture = np.where(there[:, :, None], np.asarray(colours)[level.clip(0, len(colours) - 1)], 0)
        return pd.DataFrame({"path": [f"{pdf['k'].iloc[0]}.png"], "content": [png(picture)]})

    return pixels.select(F.col(key).cast("string").alias("k"), "row", "col", F.col(value).alias("v")).groupBy("k").applyInPandas(run, "path string, content binary")
