"""Least-squares fits for each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as la

AXES = ("x", "y", "z")


def affine_fit(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, p array of eight): col and row as affine functions of x, y, z.

    Sums of centred products in one aggregate after the means, then 3 x 3 normal equations in
    closed form; null where the points are coplanar. Groups of any size stay distributed.
    """
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{c}") for c in (*AXES, "col", "row")], F.count(F.lit(1)).alias("n"))
    both = df.join(means, keys)
    d = {c: F.col(c) - F.col(f"m_{c}") for c in (*AXES, "col", "row")}
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]] + [(a, t) for t in ("col", "row") for a in AXES]
    sums = both.groupBy(*keys, "n", *[f"m_{c}" for c in (*AXES, "col", "row")]).agg(*[F.sum(d[a] * d[b]).alias(f"s_{a}_{b}") for a, b in pairs])
    s = lambda a, b: F.col(f"s_{min(a, b)}_{max(a, b)}") if a in AXES and b in AXES else F.col(f"s_{a}_{b}")
    inv = la.inv3([[s(a, b) for b in AXES] for a in AXES])
    out = []
    for t in ("col", "row"):
        g = la.matvec(inv, [s(a, t) for a in AXES])
        out += [*g, F.col(f"m_{t}") - la.dot(g, [F.col(f"m_{a}") for a in AXES])]
    return sums.select(*keys, "n", F.array(*out).alias("p"))


def rq(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K, R, t of a 3 x 4 projection matrix: K upper triangular with positive diagonal and K[2, 2] = 1, det R = 1."""
    m = p[:, :3]
    flip = np.eye(3)[::-1]
    q, r = np.linalg.qr((flip @ m).T)
    k, rot = flip @ r.T @ flip, flip @ q.T
    sign = np.diag(np.where(np.diag(k) < 0, -1.0, 1.0))
    k, rot = k @ sign, sign @ rot
    turn = np.linalg.det(rot)
    t = np.linalg.solve(k, p[:, 3])
    if turn < 0:  # the matrix is known up to a factor only, which may be negative
        rot, t = -rot, -t
    return k / k[2, 2], rot, t


def dlt(xyz: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """3 x 4 matrix of at least six points by the last right singular vector of the design matrix, on normalised coordinates."""

    def normalise(v):
        mean, size = v.mean(0), np.sqrt(((v - v.mean(0)) ** 2).sum(1).mean())
        t = np.eye(v.shape[1] + 1)
        t[:-1] /= size
        t[:-1, -1] = -mean / size
        return np.c_[v, np.ones(len(v))] @ t.T, t

    a, ta = normalise(xyz)
    b, tb = normalise(pixels)
    zero = np.zeros_like(a)
    rows = np.r_[np.c_[a, zero, -b[:, :1] * a], np.c_[zero, a, -b[:, 1:2] * a]]
    # the triangle of a QR has the same right singular vectors and twelve rows
    p = np.linalg.svd(np.linalg.qr(rows, mode="r"))[2][-1].reshape(3, 4)
    return np.linalg.inv(tb) @ p @ ta


def dlt_fit(df: DataFrame, key: str) -> DataFrame:
    """(key, k array of nine, r array of nine, t array of three, n) from (key, x, y, z, col, row); null with fewer than six points."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.dropna()
        out = {key: pdf[key].iloc[0], "k": None, "r": None, "t": None, "n": len(rows)}
        if len(rows) >= 6:
            k, r, t = rq(dlt(rows[list(AXES)].to_numpy(float), rows[["col", "row"]].to_numpy(float)))
            if np.isfinite(k).all():
                out |= {"k": k.ravel().tolist(), "r": r.ravel().tolist(), "t": t.tolist()}
        return pd.DataFrame([out])

    return df.select(key, *AXES, "col", "row").groupBy(key).applyInPandas(run, f"{key} {kind}, k array<double>, r array<double>, t array<double>, n long")


def align3d_fit(df: DataFrame, key: str) -> DataFrame:
    """(key, m array of nine, t array of three, singular array of three) with (x2, y2, z2) = m (x, y, z) + t in least squares."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[list(AXES)].to_numpy(float), pdf[["x2", "y2", "z2"]].to_numpy(float)
        out = {key: pdf[key].iloc[0], "m": None, "t": None, "singular": None}
        x, _, rank, _ = np.linalg.lstsq(a - a.mean(0), b - b.mean(0), rcond=None)
        if rank == 3:
            m = x.T
            out |= {"m": m.ravel().tolist(), "t": (b.mean(0) - m @ a.mean(0)).tolist(), "singular": np.linalg.svd(m, compute_uv=False).tolist()}
        return pd.DataFrame([out])

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, m array<double>, t array<double>, singular array<double>")
