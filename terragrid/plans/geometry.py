"""Queries on cameras, projections, geodesy and fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geodesy, rpc
from ..functions import linalg as la
from ..operators import depth, fit, sparse
from .common import CAMERA_SQL, cameras, query, r, table

# --- points near the sample area: customers -------------------------------------------------------------------
ORIGIN = (-34.49, -58.585, -30.0)
ZONE = 21
_PTS = f"p AS (SELECT c_custkey, (-34.5::DOUBLE + c_custkey % 1000 / 10000.0::DOUBLE) AS lat, (-58.6::DOUBLE + (c_custkey * 7) % 1000 / 10000.0::DOUBLE) AS lon, c_acctbal / 100 AS alt FROM customer)"


def _points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (F.lit(-34.5) + k % 1000 / F.lit(10000.0)).alias("lat"), (F.lit(-58.6) + (k * 7) % 1000 / F.lit(10000.0)).alias("lon"), (F.col("c_acctbal") / 100).alias("alt"))


def _lla():
    return [F.col(c) for c in ("lat", "lon", "alt")]


def _coefficients(k: int) -> dict:
    """A smooth rational camera for region k."""
    small = lambda salt: [math.sin(i * 1.7 + k + salt) * 1e-3 for i in range(20)]
    num_c, num_r, den_c, den_r = small(0), small(1), small(2), small(3)
    num_c[:4] = [0.001 * k, 1.0 + 0.01 * k, 0.02, 0.003]
    num_r[:4] = [0.002 * k, 0.01, -1.0 - 0.01 * k, 0.004]
    den_c[0] = den_r[0] = 1.0
    return {"rowNum": num_r, "rowDen": den_r, "colNum": num_c, "colDen": den_c, "rowOff": 2000.0 + k, "rowScale": 2500.0, "colOff": 3000.0 - k, "colScale": 3500.0, "latOff": -34.45, "latScale": 0.06, "lonOff": -58.55, "lonScale": 0.06, "altOff": 20.0, "altScale": 120.0}


def _rpc_column(c: dict):
    return F.struct(*[(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).alias(n) for n, v in c.items()])


def _rpc_cameras(spark):
    """Five cameras, one a region: a dimension of fixed size."""
    cams = [spark.range(1).select(F.lit(k).alias("cam"), _rpc_column(_coefficients(k)).alias("rpc")) for k in range(5)]
    out = cams[0]
    for c in cams[1:]:
        out = out.unionByName(c)
    return F.broadcast(out)


def _lit(x: float) -> str:
    return f"({x!r})::DOUBLE"


def _rpc_sql() -> str:
    # the published order of the cubic's terms, x latitude, y longitude, z altitude
    terms = "1, y, x, z, y*x, y*z, x*z, y*y, x*x, z*z, x*y*z, y*y*y, y*x*x, y*z*z, y*y*x, x*x*x, x*z*z, y*y*z, x*x*z, z*z*z".split(", ")
    rows = []
    for k in range(5):
        c = _coefficients(k)
        rows.append(f"({k}, {_lit(c['rowOff'])}, {_lit(c['colOff'])}, " + ", ".join("[" + ", ".join(map(_lit, c[n])) + "]" for n in ("rowNum", "rowDen", "colNum", "colDen")) + ")")
    poly = lambda n: "(" + " + ".join(f"{n}[{i}] * {t}" for i, t in enumerate(terms, 1)) + ")"
    return f"""WITH {_PTS}, k(cam, row_off, col_off, rn, rd, cn, cd) AS (VALUES {', '.join(rows)}),
        n AS (SELECT *, (lat + 34.45::DOUBLE) / 0.06::DOUBLE AS x, (lon + 58.55::DOUBLE) / 0.06::DOUBLE AS y, (alt - 20) / 120.0::DOUBLE AS z FROM p, k)
        SELECT c_custkey, cam, round({poly('cn')} / {poly('cd')} * 3500 + col_off, 4) + 0 AS col, round({poly('rn')} / {poly('rd')} * 2500 + row_off, 4) + 0 AS row FROM n"""


@query(_rpc_sql())
def rpc_project(spark, d):
    both = _points(spark, d).crossJoin(_rpc_cameras(spark))
    col, row = rpc.project(F.col("rpc"), *_lla())
    return both.select("c_custkey", "cam", r(col, 4).alias("col"), r(row, 4).alias("row"))


@query(f"WITH {_PTS} SELECT c_custkey, k::INT AS cam, true AS settled, 0.0::DOUBLE AS d_lat, 0.0::DOUBLE AS d_lon FROM p, range(5) c(k)")
def rpc_inverse(spark, d):
    """Forward, then inverse: the point itself, to a ten-millionth of a degree."""
    both = _points(spark, d).crossJoin(_rpc_cameras(spark))
    col, row = rpc.project(F.col("rpc"), *_lla())
    both = both.withColumns({"col": col, "row": row}).withColumn("at", rpc.inverse(F.col("rpc"), F.col("col"), F.col("row"), F.col("alt")))
    gap = lambda n: F.abs(F.round(F.col(f"at.{n}") - F.col(n), 7)) + 0.0
    return both.select("c_custkey", "cam", F.col("at.lat").isNotNull().alias("settled"), gap("lat").alias("d_lat"), gap("lon").alias("d_lon"))


def _ecef_sql(lat: str, lon: str, alt: str, tag: str) -> str:
    n = f"(6378137.0::DOUBLE / sqrt(1 - e2 * power(sin(radians({lat})), 2)))"
    return f"({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})) AS x{tag}, ({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})) AS y{tag}, ({n} * (1 - e2) + {alt}) * sin(radians({lat})) AS z{tag}"


_O = [f"({v})::DOUBLE" for v in ORIGIN]


@query(f"""WITH {_PTS}, c AS (SELECT (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2, radians({_O[0]}) AS p0, radians({_O[1]}) AS l0),
           o AS (SELECT *, {_ecef_sql(*_O, '0')} FROM c), q AS (SELECT *, {_ecef_sql('lat', 'lon', 'alt', '1')} FROM p, o),
           v AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, z1 - z0 AS dz FROM q)
           SELECT c_custkey, round(-sin(l0) * dx + cos(l0) * dy, 3) + 0 AS e, round(-sin(p0) * cos(l0) * dx - sin(p0) * sin(l0) * dy + cos(p0) * dz, 3) + 0 AS n,
                  round(cos(p0) * cos(l0) * dx + cos(p0) * sin(l0) * dy + sin(p0) * dz, 3) + 0 AS u FROM v""")
def geodetic_to_enu(spark, d):
    enu = geodesy.geodetic_to_enu(*_lla(), *ORIGIN)
    return _points(spark, d).select("c_custkey", *[r(c, 3).alias(n) for c, n in zip(enu, "enu")])


@query(f"WITH {_PTS} SELECT c_custkey, round(lat, 8) + 0 AS lat, round(lon, 8) + 0 AS lon, round(alt, 4) + 0 AS alt FROM p")
def enu_roundtrip(spark, d):
    enu = _points(spark, d).select("c_custkey", *[c.alias(n) for c, n in zip(geodesy.geodetic_to_enu(*_lla(), *ORIGIN), "enu")])
    back = enu.select("c_custkey", geodesy.enu_to_geodetic(F.col("e"), F.col("n"), F.col("u"), *ORIGIN).alias("p"))
    return back.select("c_custkey", r("p.lat", 8).alias("lat"), r("p.lon", 8).alias("lon"), r("p.alt", 4).alias("alt"))


_N = "(1 / 298.257223563::DOUBLE) / (2 - 1 / 298.257223563::DOUBLE)"


@query(f"""WITH {_PTS}, c AS (SELECT n, sqrt(4 * n / power(1 + n, 2)) AS e, 6378137.0::DOUBLE / (1 + n) * (1 + power(n, 2) / 4 + power(n, 4) / 64 + power(n, 6) / 256) AS a FROM (SELECT {_N} AS n)),
           k AS (SELECT *, n / 2 - 2 * power(n, 2) / 3 + 5 * power(n, 3) / 16 + 41 * power(n, 4) / 180 - 127 * power(n, 5) / 288 AS a1, 13 * power(n, 2) / 48 - 3 * power(n, 3) / 5 + 557 * power(n, 4) / 1440 + 281 * power(n, 5) / 630 AS a2,
                        61 * power(n, 3) / 240 - 103 * power(n, 4) / 140 + 15061 * power(n, 5) / 26880 AS a3, 49561 * power(n, 4) / 161280 - 179 * power(n, 5) / 168 AS a4 FROM c),
           t AS (SELECT *, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t, radians(lon + 57) AS m FROM p, k),
           x AS (SELECT *, atan2(t, cos(m)) AS xi, asinh(sin(m) / sqrt(t * t + cos(m) * cos(m))) AS eta FROM t)
           SELECT c_custkey, round(500000 + 0.9996::DOUBLE * a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 4) + 0 AS east,
                  round(10000000 + 0.9996::DOUBLE * a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 4) + 0 AS north FROM x""")
def utm_forward(spark, d):
    utm = _points(spark, d).select("c_custkey", geodesy.to_utm(F.col("lat"), F.col("lon"), ZONE, True).alias("p"))
    return utm.select("c_custkey", r("p.east", 4).alias("east"), r("p.north", 4).alias("north"))


@query(f"WITH {_PTS} SELECT c_custkey, round(lat, 8) + 0 AS lat, round(lon, 8) + 0 AS lon FROM p")
def utm_roundtrip(spark, d):
    utm = _points(spark, d).select("c_custkey", geodesy.to_utm(F.col("lat"), F.col("lon"), ZONE, True).alias("p"))
    back = utm.select("c_custkey", geodesy.from_utm(F.col("p.east"), F.col("p.north"), ZONE, True).alias("q"))
    return back.select("c_custkey", r("q.lat", 8).alias("lat"), r("q.lon", 8).alias("lon"))


# --- inverses, held against other formulas than the library's -----------------------------------------------------------------


def _rpc_locate_sql() -> str:
    """Five Newton steps from the middle of the scene, each a few named expressions."""
    terms = lambda x, y: "[" + ", ".join(t.replace("x", f"({x})").replace("y", f"({y})") for t in "1, y, x, z, y*x, y*z, x*z, y*y, x*x, z*z, x*y*z, y*y*y, y*x*x, y*z*z, y*y*x, x*x*x, x*z*z, y*y*z, x*x*z, z*z*z".split(", ")) + "]::DOUBLE[]"
    rows = []
    for k in range(5):
        c = _coefficients(k)
        rows.append(f"({k}, {_lit(c['rowOff'])}, {_lit(c['colOff'])}, " + ", ".join("[" + ", ".join(map(_lit, c[n])) + "]" for n in ("rowNum", "rowDen", "colNum", "colDen")) + ")")
    dot = lambda n, d, t: f"list_dot_product({n}, {t}) / list_dot_product({d}, {t})"
    steps = ""
    for i in range(5):
        steps += f""",
        e{i} AS (SELECT *, {terms("x", "y")} AS t0, {terms("x + 1e-4::DOUBLE", "y")} AS t1, {terms("x", "y + 1e-4::DOUBLE")} AS t2 FROM s{i}),
        f{i} AS (SELECT c_custkey, cam, rn, rd, cn, cd, x, y, z, u, v, {dot("cn", "cd", "t0")} AS u0, {dot("rn", "rd", "t0")} AS v0, ({dot("cn", "cd", "t1")} - u0) * 1e4 AS a, ({dot("cn", "cd", "t2")} - u0) * 1e4 AS b, ({dot("rn", "rd", "t1")} - v0) * 1e4 AS c, ({dot("rn", "rd", "t2")} - v0) * 1e4 AS d FROM e{i}),
        s{i + 1} AS (SELECT c_custkey, cam, rn, rd, cn, cd, x + (d * (u - u0) - b * (v - v0)) / (a * d - b * c) AS x, y + (a * (v - v0) - c * (u - u0)) / (a * d - b * c) AS y, z, u, v FROM f{i})"""
    return f"""WITH k(cam, row_off, col_off, rn, rd, cn, cd) AS (VALUES {', '.join(rows)}),
        s0 AS (SELECT c_custkey, cam, rn, rd, cn, cd, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, (c_acctbal / 100 - 20) / 120.0::DOUBLE AS z, (1500 + (c_custkey * 37) % 3001 - col_off) / 3500.0::DOUBLE AS u, (1000 + (c_custkey * 53) % 2001 - row_off) / 2500.0::DOUBLE AS v FROM customer, k){steps}
        SELECT c_custkey, cam, round(x * 0.06::DOUBLE - 34.45::DOUBLE, 7) + 0 AS lat, round(y * 0.06::DOUBLE - 58.55::DOUBLE, 7) + 0 AS lon FROM s5"""


@query(_rpc_locate_sql())
def rpc_locate(spark, d):
    """Pixels and heights of the table, located by each camera."""
    k = F.col("c_custkey")
    at = table(spark, d, "customer").select("c_custkey", (1500 + (k * 37) % 3001).cast("double").alias("col"), (1000 + (k * 53) % 2001).cast("double").alias("row"), (F.col("c_acctbal") / 100).alias("alt"))
    both = at.crossJoin(_rpc_cameras(spark)).withColumn("at", rpc.inverse(F.col("rpc"), F.col("col"), F.col("row"), F.col("alt")))
    return both.select("c_custkey", "cam", r("at.lat", 7).alias("lat"), r("at.lon", 7).alias("lon"))


_ENU = "(c_custkey % 1000 * 7 - 3000)::DOUBLE AS e, ((c_custkey * 11) % 900 * 5 - 2000)::DOUBLE AS n, c_acctbal / 50 AS u"


@query(f"""WITH c AS (SELECT c_custkey, {_ENU}, 6378137.0::DOUBLE AS a, 6378137.0::DOUBLE * (1 - 1 / 298.257223563::DOUBLE) AS b, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2, radians({_O[0]}) AS p0, radians({_O[1]}) AS l0 FROM customer),
           o AS (SELECT *, {_ecef_sql(*_O, '0')} FROM c),
           q AS (SELECT *, x0 - sin(l0) * e - sin(p0) * cos(l0) * n + cos(p0) * cos(l0) * u AS x, y0 + cos(l0) * e - sin(p0) * sin(l0) * n + cos(p0) * sin(l0) * u AS y, z0 + cos(p0) * n + sin(p0) * u AS z FROM o),
           h AS (SELECT *, sqrt(x * x + y * y) AS rr, atan2(z * a, sqrt(x * x + y * y) * b) AS th FROM q),
           f AS (SELECT *, atan2(z + (a * a - b * b) / b * power(sin(th), 3), rr - e2 * a * power(cos(th), 3)) AS lat FROM h)
           SELECT c_custkey, round(degrees(lat), 8) + 0 AS lat, round(degrees(atan2(y, x)), 8) + 0 AS lon, round(rr * cos(lat) + z * sin(lat) - a * sqrt(1 - e2 * power(sin(lat), 2)), 4) + 0 AS alt FROM f""")
def enu_inverse(spark, d):
    """Positions about the origin as latitude, longitude and height; the SQL has one step by the parametric latitude."""
    k = F.col("c_custkey")
    at = table(spark, d, "customer").select("c_custkey", (k % 1000 * 7 - 3000).cast("double").alias("e"), ((k * 11) % 900 * 5 - 2000).cast("double").alias("n"), (F.col("c_acctbal") / 50).alias("u"))
    back = at.select("c_custkey", geodesy.enu_to_geodetic(F.col("e"), F.col("n"), F.col("u"), *ORIGIN).alias("p"))
    return back.select("c_custkey", r("p.lat", 8).alias("lat"), r("p.lon", 8).alias("lon"), r("p.alt", 4).alias("alt"))


@query(f"""WITH c AS (SELECT n, 6378137.0::DOUBLE / (1 + n) * (1 + power(n, 2) / 4 + power(n, 4) / 64 + power(n, 6) / 256) AS a FROM (SELECT {_N} AS n)),
           k AS (SELECT *, n / 2 - 2 * power(n, 2) / 3 + 37 * power(n, 3) / 96 - power(n, 4) / 360 AS b1, power(n, 2) / 48 + power(n, 3) / 15 - 437 * power(n, 4) / 1440 AS b2, 17 * power(n, 3) / 480 - 37 * power(n, 4) / 840 AS b3, 4397 * power(n, 4) / 161280 AS b4,
                        2 * n - 2 * power(n, 2) / 3 - 2 * power(n, 3) + 116 * power(n, 4) / 45 AS d1, 7 * power(n, 2) / 3 - 8 * power(n, 3) / 5 - 227 * power(n, 4) / 45 AS d2, 56 * power(n, 3) / 15 - 136 * power(n, 4) / 35 AS d3, 4279 * power(n, 4) / 630 AS d4 FROM c),
           p AS (SELECT c_custkey, k.*, (6180000 + (c_custkey * 17) % 5000 - 10000000) / (0.9996::DOUBLE * a) AS xi, (350000 + (c_custkey * 29) % 9000 - 500000) / (0.9996::DOUBLE * a) AS eta FROM customer, k),
           s AS (SELECT *, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) - b4 * sin(8 * xi) * cosh(8 * eta) AS x1,
                        eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) - b4 * cos(8 * xi) * sinh(8 * eta) AS e1 FROM p),
           q AS (SELECT *, asin(sin(x1) / cosh(e1)) AS chi FROM s)
           SELECT c_custkey, round(degrees(chi + d1 * sin(2 * chi) + d2 * sin(4 * chi) + d3 * sin(6 * chi) + d4 * sin(8 * chi)), 8) + 0 AS lat, round(degrees(atan2(sinh(e1), cos(x1))) - 57, 8) + 0 AS lon FROM q""")
def utm_inverse(spark, d):
    """Eastings and northings of the table; the SQL has the series of the conformal latitude, the library Newton steps."""
    k = F.col("c_custkey")
    at = table(spark, d, "customer").select("c_custkey", (350000 + (k * 29) % 9000).cast("double").alias("e"), (6180000 + (k * 17) % 5000).cast("double").alias("n"))
    back = at.select("c_custkey", geodesy.from_utm(F.col("e"), F.col("n"), ZONE, True).alias("q"))
    return back.select("c_custkey", r("q.lat", 8).alias("lat"), r("q.lon", 8).alias("lon"))


# --- nations as perspective cameras ---------------------------------------------------------------------------


@query(f"WITH {CAMERA_SQL} SELECT k, round(r11, 6) + 0 AS r11, round(r12, 6) + 0 AS r12, round(r13, 6) + 0 AS r13, round(r23, 6) + 0 AS r23, round(r31, 6) + 0 AS r31, round(qw, 6) + 0 AS qw, round(qx, 6) + 0 AS qx, round(qy, 6) + 0 AS qy, round(qz, 6) + 0 AS qz FROM cam")
def quat_rotmat(spark, d):
    """Rotation matrix, and the quaternion that the matrix gives back."""
    c = sparse.camera_columns(F.col("camera"))
    q = la.rot_to_quat(c["r"])
    m = c["r"]
    out = {"r11": m[0][0], "r12": m[0][1], "r13": m[0][2], "r23": m[1][2], "r31": m[2][0], "qw": q[0], "qx": q[1], "qy": q[2], "qz": q[3]}
    return cameras(spark, d).select("k", *[(r(v) + 0.0).alias(n) for n, v in out.items()])


_P = ", ".join(f"{x} AS p{i}{j}" for i, line in enumerate((("fx*r11 + s*r21 + cx*r31", "fx*r12 + s*r22 + cx*r32", "fx*r13 + s*r23 + cx*r33", "fx*tx + s*ty + cx*tz"), ("fy*r21 + cy*r31", "fy*r22 + cy*r32", "fy*r23 + cy*r33", "fy*ty + cy*tz"), ("r31", "r32", "r33", "tz")), 1) for j, x in enumerate(line, 1))
_PMAX = "greatest(" + ", ".join(f"abs(p{i}{j})" for i in (1, 2, 3) for j in (1, 2, 3, 4)) + ")"


@query(f"""WITH {CAMERA_SQL}, p AS (SELECT *, {_P} FROM cam), m AS (SELECT *, {_PMAX} AS top FROM p)
           SELECT k, round(p11 / top, 8) + 0 AS p11, round(p12 / top, 8) + 0 AS p12, round(p23 / top, 8) + 0 AS p23, round(p34 / top, 8) + 0 AS p34,
                  round(-(r11 * tx + r21 * ty + r31 * tz), 6) + 0 AS c1, round(-(r12 * tx + r22 * ty + r32 * tz), 6) + 0 AS c2, round(-(r13 * tx + r23 * ty + r33 * tz), 6) + 0 AS c3 FROM m""")
def projection_matrix(spark, d):
    c = sparse.camera_columns(F.col("camera"))
    p = la.scaled(la.projection(c["k"], c["r"], c["t"]))
    centre = la.camera_center(c["r"], c["t"])
    out = {"p11": p[0][0], "p12": p[0][1], "p23": p[1][2], "p34": p[2][3]}
    return cameras(spark, d).select("k", *[(r(v, 8) + 0.0).alias(n) for n, v in out.items()], *[(r(v) + 0.0).alias(f"c{i}") for i, v in enumerate(centre, 1)])


@query(f"""WITH {CAMERA_SQL}, f AS (SELECT k, -cx / fx AS x0, 1 / fx AS ux, -s / (fx * fy) AS uy, w, h, cx, cy, fx, fy, s FROM cam),
           v AS (SELECT k, (0 - cx - s * (h / 2 - cy) / fy) / fx AS lx, (w - cx - s * (h / 2 - cy) / fy) / fx AS rx, (h / 2 - cy) / fy AS my,
                        (w / 2 - cx - s * (0 - cy) / fy) / fx AS ax, (0 - cy) / fy AS ay, (w / 2 - cx - s * (h - cy) / fy) / fx AS bx, (h - cy) / fy AS by_ FROM f)
           SELECT k, round(degrees(acos((lx * rx + my * my + 1) / sqrt((lx * lx + my * my + 1) * (rx * rx + my * my + 1)))), 6) + 0 AS left_right,
                  round(degrees(acos((ax * bx + ay * by_ + 1) / sqrt((ax * ax + ay * ay + 1) * (bx * bx + by_ * by_ + 1)))), 6) + 0 AS up_down FROM v""")
def fov_angles(spark, d):
    c = sparse.camera_columns(F.col("camera"))
    a, b = sparse.field_of_view(c["k"], c["w"], c["h"])
    return cameras(spark, d).select("k", r(a).alias("left_right"), r(b).alias("up_down"))


@query(f"""WITH {CAMERA_SQL}, c AS (SELECT k, -(r11 * tx + r21 * ty + r31 * tz) AS x, -(r12 * tx + r22 * ty + r32 * tz) AS y, -(r13 * tx + r23 * ty + r33 * tz) AS z FROM cam),
           a AS (SELECT a.k AS i, b.k AS j, degrees(acos(least(1, greatest(-1, (a.x * b.x + a.y * b.y + a.z * b.z) / (sqrt(a.x * a.x + a.y * a.y + a.z * a.z) * sqrt(b.x * b.x + b.y * b.y + b.z * b.z)))))) AS angle FROM c a JOIN c b ON a.k < b.k)
           SELECT i, j, round(angle, 4) + 0 AS angle FROM a UNION ALL SELECT j, i, round(angle, 4) FROM a UNION ALL SELECT k, k, 0.0 FROM c""")
def pairwise_angles(spark, d):
    c = sparse.camera_columns(F.col("camera"))
    v = cameras(spark, d).select("k", F.array(*la.camera_center(c["r"], c["t"])).alias("v"))
    return sparse.pairwise_angles(v, "k", 3, "v", mirrored=True).select("i", "j", r("angle", 4).alias("angle"))


def _mat(name: str) -> list[list[str]]:
    return [[f"{name}{i}{j}" for j in (1, 2, 3)] for i in (1, 2, 3)]


def _homography_sql() -> str:
    s = lambda a, b: ", ".join(f"{a}.p{i}{j} + {a}.p{i}4 * {n} / const AS {b}{i}{j}" for i in (1, 2, 3) for j, n in ((1, "n1"), (2, "n2"), (3, "n3")))
    b = _mat("b")
    det = "(b11*(b22*b33-b23*b32) - b12*(b21*b33-b23*b31) + b13*(b21*b32-b22*b31))"
    cof = lambda i, j: "(" + "{0}*{3} - {1}*{2}".format(*[b[x][y] for x in range(3) if x != j for y in range(3) if y != i]) + ")" if (i + j) % 2 == 0 else "(" + "{1}*{2} - {0}*{3}".format(*[b[x][y] for x in range(3) if x != j for y in range(3) if y != i]) + ")"
    inv = ", ".join(f"{cof(i, j)} / {det} AS i{i + 1}{j + 1}" for i in range(3) for j in range(3))
    prod = ", ".join(f"a{i}1 * i1{j} + a{i}2 * i2{j} + a{i}3 * i3{j} AS h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    top = "greatest(" + ", ".join(f"abs(h{i}{j})" for i in (1, 2, 3) for j in (1, 2, 3)) + ")"
    return f"""WITH {CAMERA_SQL}, p AS (SELECT *, {_P} FROM cam),
        pl AS (SELECT i AS plane, 0.1::DOUBLE AS n1, -0.05::DOUBLE AS n2, 1.0::DOUBLE AS n3, -(500 + 20 * i)::DOUBLE AS const FROM range(10) t(i)),
        s AS (SELECT src.k, plane, {s('ref', 'a')}, {s('src', 'b')} FROM p src, p ref, pl WHERE ref.k = 0),
        v AS (SELECT *, {inv} FROM s), h AS (SELECT k, plane, {prod} FROM v)
        SELECT k, plane, {", ".join(f"round(h{i}{j} / {top}, 6) + 0 AS h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))} FROM h"""


@query(_homography_sql())
def homography(spark, d):
    """Each camera against ten planes, to the first camera. Planes and the reference are a dimension of fixed size."""
    cams = cameras(spark, d)
    ref = cams.where("k = 0").select(F.col("camera").alias("ref"))
    planes = spark.range(10).select(F.col("id").alias("plane"))
    both = cams.crossJoin(F.broadcast(ref)).crossJoin(F.broadcast(planes))
    a, b = sparse.camera_columns(F.col("ref")), sparse.camera_columns(F.col("camera"))
    normal, constant = [F.lit(0.1), F.lit(-0.05), F.lit(1.0)], (-(500 + 20 * F.col("plane"))).cast("double")
    out, h = la.homography(both, la.projection(a["k"], a["r"], a["t"]), la.projection(b["k"], b["r"], b["t"]), normal, constant)
    return out.select("k", "plane", *[(r(h[i][j]) + 0.0).alias(f"h{i + 1}{j + 1}") for i in range(3) for j in range(3)])


# --- lines as observations ------------------------------------------------------------------------------------
_INV = "[1.0 + k / 100.0::DOUBLE, 0.01, -5.0, 0.001, 0.02, 1.0 - k / 100.0::DOUBLE, 3.0, 0.002, 0.0, 0.001, 1.0, 0.5, 0.0001, 0.0, 1.0, 0.001]"


@query(f"""WITH m AS (SELECT n_nationkey AS k, {_INV}::DOUBLE[] AS m FROM nation), o AS (SELECT l_orderkey, l_linenumber, s_nationkey AS k, l_quantity AS c, (l_partkey % 100)::DOUBLE AS r, l_discount * 100 - 1 AS z FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount * 100 - 1 > 0),
           v AS (SELECT *, m[13] * c + m[14] * r + m[15] + m[16] * z AS w FROM o JOIN m USING (k))
           SELECT l_orderkey, l_linenumber, round((m[1] * c + m[2] * r + m[3] + m[4] * z) / w, 6) + 0 AS x, round((m[5] * c + m[6] * r + m[7] + m[8] * z) / w, 6) + 0 AS y, round((m[9] * c + m[10] * r + m[11] + m[12] * z) / w, 6) + 0 AS z FROM v""")
def depth_unproject(spark, d):
    k = F.col("n_nationkey")
    m = table(spark, d, "nation").select(k.alias("view"), F.array(1 + k / 100.0, *[F.lit(x) for x in (0.01, -5.0, 0.001, 0.02)], 1 - k / 100.0, *[F.lit(x) for x in (3.0, 0.002, 0.0, 0.001, 1.0, 0.5, 0.0001, 0.0, 1.0, 0.001)]).alias("m"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("view"))
    o = table(spark, d, "lineitem").join(s, "l_suppkey").select("view", "l_orderkey", "l_linenumber", (F.col("l_partkey") % 100).alias("row"), F.col("l_quantity").alias("col"), (F.col("l_discount") * 100 - 1).alias("depth"))
    return depth.unproject(o, m, carry=("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", *[r(c).alias(c) for c in "xyz"])


_OBS = """o AS (SELECT l_suppkey AS img, l_extendedprice / 100 AS z, l_quantity * 4 + l_extendedprice / 500 - 30 AS depth, l_linenumber - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS track_len FROM lineitem)"""


def _range_sql(source: str, key: str, value: str, above: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    group = f"GROUP BY {key}" if key else ""
    lead = f"{key}," if key else ""
    return f"""(SELECT {lead} max(v) FILTER (WHERE i = floor(0.02::DOUBLE * n)) - 10 AS lo, max(v) FILTER (WHERE i = floor(0.98::DOUBLE * n)) + {above} AS hi
               FROM (SELECT {lead} {value} AS v, row_number() OVER ({part} ORDER BY {value}) - 1 AS i, count(*) OVER ({part}) AS n FROM {source} WHERE {value} > 0) {group})"""


_REPARAM = f"""{_OBS}, raw AS {_range_sql('o', 'img', 'depth', '30')}, zr AS (SELECT quantile_cont(z, 0.01) - 20 AS z_ref FROM o),
    pd AS (SELECT o.*, lo, lo * (z - z_ref) / nullif(depth, 0) AS pd FROM o JOIN raw USING (img), zr)"""


def _observed(spark, d):
    rows = table(spark, d, "lineitem")
    n = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("track_len"))
    return rows.join(n, "l_orderkey").select(F.col("l_suppkey").alias("img"), (F.col("l_extendedprice") / 100).alias("z"), (F.col("l_quantity") * 4 + F.col("l_extendedprice") / 500 - 30).alias("depth"), (F.col("l_linenumber") - 1).alias("place"), "track_len").withColumn("w", F.col("depth"))


def _heights(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_extendedprice") / 100).alias("z"))


@query(f"""WITH {_REPARAM}, rp AS {_range_sql('pd', 'img', 'pd', '30')}
           SELECT img, round(raw.lo, 4) + 0 AS raw_min, round(raw.hi, 4) + 0 AS raw_max, round(rp.lo, 4) + 0 AS plane_min, round(rp.hi, 4) + 0 AS plane_max, round(-raw.lo * z_ref, 4) + 0 AS last FROM raw JOIN rp USING (img), zr""")
def reparam_depth(spark, d):
    got = depth.reparametrised(_observed(spark, d), _heights(spark, d))["ranges"].where("plane_min is not null")
    return got.select("img", *[r(c, 4).alias(c) for c in ("raw_min", "raw_max", "plane_min", "plane_max")], r(F.col("last_row")[3], 4).alias("last"))


@query(f"WITH {_REPARAM}, l AS (SELECT pd FROM pd WHERE place = track_len - 1) SELECT round(lo, 4) + 0 AS depth_min, round(hi, 4) + 0 AS depth_max FROM {_range_sql('l', '', 'pd', '100')}")
def common_range(spark, d):
    plane = depth.reparametrised(_observed(spark, d), _heights(spark, d))["obs"]
    return depth.common_range(plane).select(r("depth_min", 4).alias("depth_min"), r("depth_max", 4).alias("depth_max"))


_SEEN = "l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z"


@query(f"""WITH {CAMERA_SQL}, o AS (SELECT l_suppkey, s_nationkey AS k, {_SEEN}, l_tax * 4000 AS col, l_linenumber * 60.0::DOUBLE AS row FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
           a AS (SELECT o.*, fx, fy, cx, cy, s, r11 * x + r12 * y + r13 * z + tx AS lx, r21 * x + r22 * y + r23 * z + ty AS ly, r31 * x + r32 * y + r33 * z + tz AS lz, (row - cy) / fy AS v, (col - cx - s * (row - cy) / fy) / fx AS u FROM o JOIN cam USING (k)),
           b AS (SELECT *, (lx * u + ly * v + lz) / (u * u + v * v + 1) AS f, sqrt(power((fx * lx + s * ly + cx * lz) / lz - col, 2) + power((fy * ly + cy * lz) / lz - row, 2)) AS proj FROM a),
           c AS (SELECT *, sqrt(power(u * f - lx, 2) + power(v * f - ly, 2) + power(f - lz, 2)) AS inv FROM b)
           SELECT l_suppkey, round(avg(proj), 4) + 0 AS mean_proj, round(median(proj), 4) + 0 AS median_proj, round(max(proj), 4) + 0 AS max_proj, round(avg(inv), 4) + 0 AS mean_inv, round(median(inv), 4) + 0 AS median_inv, round(max(inv), 4) + 0 AS max_inv FROM c GROUP BY 1""")
def camera_error(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("k"))
    o = table(spark, d, "lineitem").join(s, "l_suppkey").select("l_suppkey", "k", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"), (F.col("l_tax") * 4000).alias("col"), (F.col("l_linenumber") * 60.0).alias("row"))
    cams = sparse.camera_matrices(cameras(spark, d).withColumnRenamed("k", "cam")).select("cam", F.col("k").alias("km"), "r", "t")
    o = o.join(cams, o["k"] == cams["cam"])
    proj, inv = sparse.projection_errors(sparse.matrix("km"), sparse.matrix("r"), [F.col("t")[i] for i in range(3)], [F.col(a) for a in "xyz"], F.col("col"), F.col("row"))
    out = sparse.camera_error(o.select("l_suppkey", proj.alias("p"), inv.alias("i")), ["l_suppkey"], F.col("p"), F.col("i"))
    return out.select("l_suppkey", *[r(c, 4).alias(c) for c in out.columns[1:]])


_C = ["x", "y", "z"]


def _affine_sql() -> str:
    d = {c: f"({c} - avg({c}) OVER g) AS d{c}" for c in (*_C, "col", "row")}
    s = ", ".join(f"sum(d{a} * d{b}) AS s{a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"), *[(a, t) for t in ("col", "row") for a in _C]))
    det = "(sxx*(syy*szz-syz*syz) - sxy*(sxy*szz-syz*sxz) + sxz*(sxy*syz-syy*sxz))"
    gx = lambda t: f"((sx{t}*(syy*szz-syz*syz) - sxy*(sy{t}*szz-syz*sz{t}) + sxz*(sy{t}*syz-syy*sz{t})) / {det})"
    gy = lambda t: f"((sxx*(sy{t}*szz-syz*sz{t}) - sx{t}*(sxy*szz-syz*sxz) + sxz*(sxy*sz{t}-sy{t}*sxz)) / {det})"
    gz = lambda t: f"((sxx*(syy*sz{t}-sy{t}*syz) - sxy*(sxy*sz{t}-sy{t}*sxz) + sx{t}*(sxy*syz-syy*sxz)) / {det})"
    return f"""WITH o AS (SELECT l_suppkey, {_SEEN}, l_tax * 400 + l_quantity AS col, l_linenumber * 6.0::DOUBLE - l_extendedprice / 3000 AS row FROM lineitem),
        c AS (SELECT *, {', '.join(d.values())} FROM o WINDOW g AS (PARTITION BY l_suppkey)),
        s AS (SELECT l_suppkey, count(*)::BIGINT AS n, {', '.join(f'avg({c}) AS m{c}' for c in (*_C, 'col', 'row'))}, {s} FROM c GROUP BY 1)
        SELECT l_suppkey, n, round({gx('col')}, 4) + 0 AS p1, round({gy('col')}, 4) + 0 AS p2, round({gz('col')}, 4) + 0 AS p3, round(mcol - {gx('col')} * mx - {gy('col')} * my - {gz('col')} * mz, 4) + 0 AS p4,
               round({gx('row')}, 4) + 0 AS p5, round({gy('row')}, 4) + 0 AS p6, round({gz('row')}, 4) + 0 AS p7, round(mrow - {gx('row')} * mx - {gy('row')} * my - {gz('row')} * mz, 4) + 0 AS p8 FROM s"""


@query(_affine_sql())
def affine_fit(spark, d):
    o = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"), (F.col("l_tax") * 400 + F.col("l_quantity")).alias("col"), (F.col("l_linenumber") * 6.0 - F.col("l_extendedprice") / 3000).alias("row"))
    out = fit.affine_fit(o, ["l_suppkey"])
    return out.select("l_suppkey", "n", *[r(F.col("p")[i - 1], 4).alias(f"p{i}") for i in range(1, 9)])


_ROT = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


@query(f"""WITH {CAMERA_SQL} SELECT k, true AS fitted, {", ".join(f"round({c}, 3) + 0 AS {c}" for c in ("fx", "fy", "cx", "cy", "s", "tx", "ty", "tz"))}, {", ".join(f"round({c}, 5) + 0 AS {c}" for c in _ROT)}, 0.0::DOUBLE AS below FROM cam""")
def dlt_fit(spark, d):
    """Exact projections of a lattice of 350 points by each nation's camera: the fit gives the camera back."""
    c = sparse.camera_columns(F.col("camera"))
    i = F.col("id")
    grid = spark.range(350).select(((i % 10) * 12.0 - 60).alias("x"), ((i / 10).cast("int") % 7 * 11.0 - 30).alias("y"), ((i / 70).cast("int") * 9.0 + i % 3).alias("z"))
    both = cameras(spark, d).crossJoin(F.broadcast(grid))
    col, row = la.apply_projection(la.projection(c["k"], c["r"], c["t"]), [F.col(a) for a in "xyz"])
    out = fit.dlt_fit(both.select(F.col("k").alias("cam"), "x", "y", "z", col.alias("col"), row.alias("row")), "cam")
    return out.select(F.col("cam").alias("k"), F.col("k").isNotNull().alias("fitted"), *[r(F.col("k")[i], 3).alias(n) for i, n in ((0, "fx"), (4, "fy"), (2, "cx"), (5, "cy"), (1, "s"))], *[r(F.col("t")[i], 3).alias(n) for i, n in enumerate(("tx", "ty", "tz"))], *[r(F.col("r")[i], 5).alias(n) for i, n in enumerate(_ROT)], r(F.abs(F.col("k")[3]) + F.abs(F.col("k")[6]) + F.abs(F.col("k")[7]), 5).alias("below"))


_ALIGN = {"m11": 2.0, "m12": 0.0, "m13": 0.0, "m21": 0.0, "m22": 1.0, "m23": 0.5, "m31": -1.0, "m32": 0.0, "m33": 1.0}


@query(f"""SELECT r_regionkey, true AS fitted, {", ".join(f"({v})::DOUBLE AS {n}" for n, v in _ALIGN.items())}, (r_regionkey - 3)::DOUBLE AS t1, 0.0::DOUBLE AS t2, 0.0::DOUBLE AS t3, 2.0::DOUBLE AS product FROM region""")
def align3d_fit(spark, d):
    i = F.col("id")
    grid = spark.range(60).select(((i % 5) * 1.0).alias("x"), ((i / 5).cast("int") % 4 * 2.0).alias("y"), ((i / 20).cast("int") * 3.0 + i % 2).alias("z"))
    both = table(spark, d, "region").select("r_regionkey").crossJoin(F.broadcast(grid))
    both = both.select("r_regionkey", "x", "y", "z", (2 * F.col("x") + F.col("r_regionkey") - 3).alias("x2"), (F.col("y") + 0.5 * F.col("z")).alias("y2"), (F.col("z") - F.col("x")).alias("z2"))
    out = fit.align3d_fit(both, "r_regionkey")
    return out.select("r_regionkey", F.col("m").isNotNull().alias("fitted"), *[r(F.col("m")[i], 4).alias(n) for i, n in enumerate(_ALIGN)], *[r(F.col("t")[i], 4).alias(f"t{i + 1}") for i in range(3)], r(F.aggregate("singular", F.lit(1.0), lambda a, x: a * x), 4).alias("product"))
