"""Rational polynomial camera as Columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of (lat, lon, alt) of the twenty terms, in file order.
TERMS = ((0, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1), (0, 2, 0), (2, 0, 0), (0, 0, 2), (1, 1, 1), (0, 3, 0), (2, 1, 0), (0, 1, 2), (1, 2, 0), (3, 0, 0), (1, 0, 2), (0, 2, 1), (2, 0, 1), (0, 0, 3))
OFFSETS = ("rowOff", "rowScale", "colOff", "colScale", "latOff", "latScale", "lonOff", "lonScale", "altOff", "altScale")


def _monomials(x, y, z) -> list:
    out = []
    for i, j, k in TERMS:
        factors = [x] * i + [y] * j + [z] * k
        term = factors[0] if factors else None
        for f in factors[1:]:
            term = term * f
        out.append(term)
    return out


def polynomial(c: Column, x: Column, y: Column, z: Column) -> Column:
    """c: array of twenty coefficients."""
    total = c[0]
    for i, m in enumerate(_monomials(x, y, z)[1:], 1):
        total = total + c[i] * m
    return total


def project(rpc: Column, lat: Column, lon: Column, alt: Column) -> tuple[Column, Column]:
    """(col, row); null where a denominator is zero."""
    x, y, z = (lat - rpc["latOff"]) / rpc["latScale"], (lon - rpc["lonOff"]) / rpc["lonScale"], (alt - rpc["altOff"]) / rpc["altScale"]
    ratio = lambda a, b: F.try_divide(polynomial(rpc[a], x, y, z), polynomial(rpc[b], x, y, z))
    return ratio("colNum", "colDen") * rpc["colScale"] + rpc["colOff"], ratio("rowNum", "rowDen") * rpc["rowScale"] + rpc["rowOff"]


def _np_poly(c: np.ndarray, x, y, z):
    terms = np.stack([np.ones_like(x) if m is None else m for m in _monomials(x, y, z)])
    return np.einsum("ni,in->n", c, terms)


def locate(rpc: dict[str, np.ndarray], col: np.ndarray, row: np.ndarray, alt: np.ndarray, cap: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lon) at a pixel and altitude by Newton steps with difference quotients, at most ``cap``; NaN if they don't settle.

    Rows leave the loop once they have settled or aren't finite, so one bad row doesn't make its batch go on."""
    u, v = (col - rpc["colOff"]) / rpc["colScale"], (row - rpc["rowOff"]) / rpc["rowScale"]
    z = (alt - rpc["altOff"]) / rpc["altScale"]

    def image(rows, x, y):
        ratio = lambda a, b: _np_poly(rpc[a][rows], x, y, z[rows]) / _np_poly(rpc[b][rows], x, y, z[rows])
        return ratio("colNum", "colDen"), ratio("rowNum", "rowDen")

    x, y = np.zeros_like(u), np.zeros_like(u)
    settled = np.zeros(len(u), bool)
    left = np.flatnonzero(np.isfinite(u) & np.isfinite(v) & np.isfinite(z))
    step = 1e-4
    with np.errstate(all="ignore"):
        for i in range(cap + 1):
            px, py = x[left], y[left]
            cu, cv = image(left, px, py)
            du, dv = u[left] - cu, v[left] - cv
            near = (du * du < 1e-18) & (dv * dv < 1e-18)
            settled[left] = (du * du < 1e-14) & (dv * dv < 1e-14)
            on = ~near & np.isfinite(du) & np.isfinite(dv)
            left, px, py, cu, cv, du, dv = left[on], px[on], py[on], cu[on], cv[on], du[on], dv[on]
            if i == cap or not len(left):
                break
            (xu, xv), (yu, yv) = image(left, px + step, py), image(left, px, py + step)
            a, b, c, d = (xu - cu) / step, (yu - cu) / step, (xv - cv) / step, (yv - cv) / step
            det = a * d - b * c
            x[left], y[left] = px + (d * du - b * dv) / det, py + (a * dv - c * du) / det
    x, y = np.where(settled, x, np.nan), np.where(settled, y, np.nan)
    return x * rpc["latScale"] + rpc["latOff"], y * rpc["lonScale"] + rpc["lonOff"]


def inverse(rpc: Column, col: Column, row: Column, alt: Column) -> Column:
    """struct(lat, lon) at a pixel and altitude; null where the steps don't settle."""

    @F.pandas_udf("lat double, lon double")
    def run(r: pd.DataFrame, c: pd.Series, w: pd.Series, z: pd.Series) -> pd.DataFrame:
        if not len(c):
            return pd.DataFrame({"lat": [], "lon": []}, dtype=float)
        table = {k: np.stack(r[k].to_numpy()) if k[3:] in ("Num", "Den") else r[k].to_numpy(float) for k in r.columns}
        lat, lon = locate(table, c.to_numpy(float), w.to_numpy(float), z.to_numpy(float))
        return pd.DataFrame({"lat": lat, "lon": lon}).astype(object).where(lambda d: d.notna(), None)

    return run(rpc, col, row, alt)
