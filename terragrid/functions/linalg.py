"""Small matrices of Columns, written out so that whole-stage codegen sees plain arithmetic.

A vector is a list of Columns, a matrix a list of rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = list
Matrix = list


def bind(df: DataFrame, name: str, m: Matrix) -> tuple[DataFrame, Matrix]:
    """The entries of ``m`` as columns of ``df``, and a matrix that refers to them.

    Long chains of products are bound step by step: each entry is then computed once, where a
    written-out product would repeat it in every term."""
    names = [[f"{name}{i}_{j}" for j in range(len(r))] for i, r in enumerate(m)]
    out = df.withColumns({n: x for ns, r in zip(names, m) for n, x in zip(ns, r)})
    return out, [[F.col(n) for n in ns] for ns in names]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(add, [x * y for x, y in zip(a, b)])


def transpose(m: Matrix) -> Matrix:
    return [list(r) for r in zip(*m)]


def matvec(m: Matrix, v: Vector) -> Vector:
    return [dot(r, v) for r in m]


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return [[dot(r, c) for c in zip(*b)] for r in a]


def norm(v: Vector) -> Column:
    return F.sqrt(dot(v, v))


def det3(m: Matrix) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def inv3(m: Matrix) -> Matrix:
    """By the adjugate; null where singular."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = F.nullif(det3(m), F.lit(0.0))
    adj = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    return [[x / det for x in r] for r in adj]


def quat_to_rot(q: Vector) -> Matrix:
    """Rotation matrix of a quaternion (w, x, y, z), which is normalised."""
    n = F.nullif(norm(q), F.lit(0.0))
    w, x, y, z = (c / n for c in q)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def rot_to_quat(m: Matrix) -> Vector:
    """Quaternion (w >= 0) of a rotation matrix: each part's size from the trace, its sign from the skew part.

    At half turns (w = 0) signs come from the largest part's row."""
    (a, b, c), (d, e, f), (g, h, i) = m
    half = lambda s: F.sqrt(F.greatest(s, F.lit(0.0))) / 2
    w = half(1 + a + e + i)
    x, y, z = half(1 + a - e - i), half(1 - a + e - i), half(1 - a - e + i)
    sign = lambda s: F.when(s < 0, -1.0).otherwise(1.0)
    turn = w > 1e-9
    sx = F.when(turn, sign(h - f)).otherwise(F.lit(1.0))
    sy = F.when(turn, sign(c - g)).when(x > 1e-9, sign(b + d)).otherwise(F.lit(1.0))
    sz = F.when(turn, sign(d - b)).when(x > 1e-9, sign(c + g)).when(y > 1e-9, sign(f + h)).otherwise(F.lit(1.0))
    return [w, sx * x, sy * y, sz * z]


def intrinsics(fx, fy, cx, cy, s) -> Matrix:
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[fx, s, cx], [zero, fy, cy], [zero, zero, one]]


def projection(k: Matrix, r: Matrix, t: Vector) -> Matrix:
    """The 3 x 4 matrix K [R | t]."""
    return matmul(k, [row + [x] for row, x in zip(r, t)])


def camera_center(r: Matrix, t: Vector) -> Vector:
    return [-x for x in matvec(transpose(r), t)]


def max_abs(m: Matrix) -> Column:
    return F.greatest(*[F.abs(x) for r in m for x in r])


def scaled(m: Matrix) -> Matrix:
    """Divided by the largest absolute entry."""
    top = F.nullif(max_abs(m), F.lit(0.0))
    return [[x / top for x in r] for r in m]


def angle_degrees(a: Vector, b: Vector) -> Column:
    """Angle between vectors; null for a zero vector."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(c.isNotNull(), F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))))


def apply_projection(p: Matrix, xyz: Vector) -> tuple[Column, Column]:
    """(col, row) of a point under a 3 x 4 matrix."""
    u, v, w = matvec(p, [*xyz, F.lit(1.0)])
    return F.try_divide(u, w), F.try_divide(v, w)


def homography(df: DataFrame, ref_p: Matrix, src_p: Matrix, normal: Vector, constant, name: str = "h") -> tuple[DataFrame, Matrix]:
    """From the source image to the reference image by a plane, scaled: columns added to ``df``."""
    kept = df.columns
    df, ref_p = bind(df, "__rp", ref_p)
    df, src_p = bind(df, "__sp", src_p)
    flat = lambda p: [[p[i][j] + p[i][3] * normal[j] / constant for j in range(3)] for i in range(3)]
    df, ref = bind(df, "__rs", flat(ref_p))
    df, src = bind(df, "__ss", flat(src_p))
    df, inverse = bind(df, "__in", inv3(src))
    df, product = bind(df, "__pr", matmul(ref, inverse))
    df, out = bind(df, name, scaled(product))
    return df.select(*kept, *[c for r in out for c in r]), out
