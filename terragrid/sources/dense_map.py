"""Dense maps: a text header "w&h&c&", then float32 values with the column running fastest across channels last."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import parsed, read_files


def decode(raw: bytes) -> np.ndarray:
    """(height, width) or (height, width, channels) array."""
    at = -1
    for _ in range(3):
        at = raw.index(b"&", at + 1)
    w, h, c = (int(x) for x in raw[:at].split(b"&"))
    values = np.frombuffer(raw, "<f4", w * h * c, at + 1)
    out = values.reshape((w, h, c), order="F").transpose(1, 0, 2)
    return out[:, :, 0] if c == 1 else out


def encode(a: np.ndarray) -> bytes:
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, c = a.shape
    return f"{w}&{h}&{c}&".encode() + a.astype("<f4").transpose(1, 0, 2).tobytes(order="F")


def _rows(path: str, raw: bytes):
    a = decode(raw)
    view = path.rsplit("/", 1)[-1]
    row, col = np.indices(a.shape, "i4").reshape(2, -1)
    yield pa.table([pa.array([view] * a.size, pa.string()), pa.array(row), pa.array(col), pa.array(a.astype("f4").ravel())], names=["view", "row", "col", "depth"])


def read_depth_maps(spark: SparkSession, path: str, kind: str = "geometric", errors: str = "raise") -> DataFrame:
    """(view, row, col, depth) of all maps of a kind; view is the image's name, without ".<kind>.bin"."""
    out = parsed(read_files(spark, path, f"*.{kind}.bin"), _rows, "view string, row int, col int, depth float", errors)
    return out.withColumn("view", F.expr(f"substring(view, 1, length(view) - {len(kind) + 5})"))


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(view, m): image name and sixteen numbers a line."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(f[0].alias("view"), F.transform(F.slice(f, 2, 16), lambda x: x.cast("double")).alias("m"))
