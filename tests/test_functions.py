import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.functions import geodesy, image, names, rpc
from terragrid.functions import linalg as la


def one(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def mat(m):
    return [[F.lit(float(x)) for x in r] for r in m]


def values(spark, m):
    return np.array(spark.range(1).select(*[c.alias(f"c{i}{j}") for i, r in enumerate(m) for j, c in enumerate(r)]).first()).reshape(len(m), -1).astype(float)


def test_matrices_equal_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((3, 3)), rng.random((3, 3))
    assert values(spark, la.matmul(mat(a), mat(b))) == pytest.approx(a @ b)
    assert values(spark, la.inv3(mat(a))) == pytest.approx(np.linalg.inv(a))
    assert spark.range(1).select(*la.inv3(mat(np.ones((3, 3))))[0]).first()[0] is None
    s = values(spark, la.scaled(mat(a - 0.5)))
    assert np.abs(s).max() == 1


@pytest.mark.parametrize("q", [(1, 0, 0, 0), (0.5, 0.1, -0.3, 0.7), (-0.2, 0.4, 0.4, 0.1), (0, 1, 0, 0), (0, 0.6, -0.8, 0), (0, 0, 0, 2)])
def test_quaternion_and_rotation_round_trip(spark, q):
    r = values(spark, la.quat_to_rot([F.lit(float(x)) for x in q]))
    assert r @ r.T == pytest.approx(np.eye(3), abs=1e-12) and np.linalg.det(r) == pytest.approx(1)
    back = values(spark, [la.rot_to_quat(mat(r))])[0]
    n = np.array(q) / np.linalg.norm(q)
    assert min(np.abs(back - n).max(), np.abs(back + n).max()) < 1e-7 and back[0] >= 0


def test_angles(spark):
    f = lambda a, b: spark.range(1).select(la.angle_degrees([F.lit(float(x)) for x in a], [F.lit(float(x)) for x in b])).first()[0]
    assert f((1, 2, 3), (1, 2, 3)) == pytest.approx(0, abs=1e-5)
    assert f((1, 0, 0), (-1, 0, 0)) == pytest.approx(180)
    assert f((0, 0, 0), (1, 0, 0)) is None


def test_homography_by_a_plane(spark):
    rng = np.random.default_rng(2)
    p1, p2 = rng.random((3, 4)), rng.random((3, 4))
    n, c = np.array([0.1, 0.2, 1.0]), -3.0
    df, h = la.homography(spark.range(1), mat(p1), mat(p2), [F.lit(float(x)) for x in n], F.lit(c))
    got = np.array(df.select(*[x for r in h for x in r]).first()).reshape(3, 3)
    s1, s2 = p1[:, :3] + np.outer(p1[:, 3], n) / c, p2[:, :3] + np.outer(p2[:, 3], n) / c
    want = s1 @ np.linalg.inv(s2)
    assert got == pytest.approx(want / np.abs(want).max())


def test_geodesy_round_trips(spark):
    rng = np.random.default_rng(7)
    zone = 21
    rows = [(i, float(a), geodesy.central_meridian(zone) + float(b), float(h)) for i, (a, b, h) in enumerate(zip(rng.uniform(-79, 79, 60), rng.uniform(-2.9, 2.9, 60), rng.uniform(-100, 5000, 60)))]
    df = spark.createDataFrame(rows, "i int, lat double, lon double, alt double")
    c = [F.col(x) for x in ("lat", "lon", "alt")]
    enu = df.select("i", *[x.alias(n) for x, n in zip(geodesy.geodetic_to_enu(*c, 10.0, -57.0, 3.0), "enu")])
    back = enu.select("i", geodesy.enu_to_geodetic(F.col("e"), F.col("n"), F.col("u"), 10.0, -57.0, 3.0).alias("p")).select("i", "p.*")
    got = {r["i"]: r for r in back.collect()}
    for i, lat, lon, alt in rows:
        assert (got[i]["lat"], got[i]["lon"]) == pytest.approx((lat, lon), abs=1e-8) and got[i]["alt"] == pytest.approx(alt, abs=1e-3)
    for south in (False, True):
        utm = df.select("i", geodesy.to_utm(c[0], c[1], zone, south).alias("p"))
        at = {r["i"]: r["q"] for r in utm.select("i", geodesy.from_utm(F.col("p.east"), F.col("p.north"), zone, south).alias("q")).collect()}
        for i, lat, lon, _ in rows:
            if (lat < 0) == south:
                assert (at[i]["lat"], at[i]["lon"]) == pytest.approx((lat, lon), abs=1e-9)


def test_utm_reference_points(spark):
    at = lambda lat, lon, south: one(spark, lat=lat, lon=lon).select(geodesy.to_utm(F.col("lat"), F.col("lon"), 32, south).alias("p")).first()["p"]
    e, n = at(47.9941214, 7.8509671, False)
    s = at(-47.9941214, 7.8509671, True)
    assert s[0] == pytest.approx(e) and s[1] == pytest.approx(1e7 - n)
    # on the central meridian the northing is the scaled meridian arc, known at 45 degrees
    e, n = at(45.0, 9.0, False)
    assert e == pytest.approx(500000) and n == pytest.approx(0.9996 * 4984944.378, abs=0.01)


def test_rpc_inverse_returns_the_point_or_null(spark):
    from terragrid.plans.geometry import _coefficients, _rpc_column

    rows = spark.createDataFrame([(-34.45, -58.55, 20.0), (-34.5, -58.6, 100.0), (-34.41, -58.5, -10.0)], "lat double, lon double, alt double").withColumn("rpc", _rpc_column(_coefficients(2)))
    col, row = rpc.project(F.col("rpc"), F.col("lat"), F.col("lon"), F.col("alt"))
    rows = rows.withColumns({"c": col, "r": row})
    for x in rows.withColumn("at", rpc.inverse(F.col("rpc"), F.col("c"), F.col("r"), F.col("alt"))).collect():
        assert (x["at"]["lat"], x["at"]["lon"]) == pytest.approx((x["lat"], x["lon"]), abs=1e-8)
    flat = _coefficients(0) | {"colNum": [0.0] * 20, "rowNum": [0.0] * 20}
    bad = one(spark, a=0.0).withColumn("rpc", _rpc_column(flat)).select(rpc.inverse(F.col("rpc"), F.lit(9.0), F.lit(9.0), F.lit(0.0)).alias("at")).first()
    assert bad["at"]["lat"] is None


def box(spark, a, b):
    return spark.range(1).select(image.overlap([F.lit(x) for x in a], [F.lit(x) for x in b]).alias("o")).first()["o"]


def test_boxes(spark):
    o = box(spark, (0, 0, 50, 40), (48, 10, 30, 40))
    assert tuple(o)[:4] == (48, 10, 2, 30) and (o["first"], o["second"]) == pytest.approx((60 / 2000, 60 / 1200))
    assert (lambda p: (p["first"], p["second"]))(box(spark, (48, 10, 30, 40), (0, 0, 50, 40))) == pytest.approx((60 / 1200, 60 / 2000))
    for a, b in (((0, 0, 5, 5), (4, 0, 5, 5)), ((0, 0, 5, 5), (9, 9, 2, 2)), ((0, 0, 5, 5), (2, 2, 1, 1))):
        assert tuple(box(spark, a, b)) == (None,) * 4 + (0.0, 0.0)
    assert box(spark, (0, 0, 5, 5), (0, 0, 5, 5))["first"] == 1.0


def brute_box(a, b):
    """Sorted interval ends, as the workload words it."""
    out = []
    for k in (0, 1):
        ends = sorted([(1, a[k]), (1, a[k] + a[k + 2] - 1), (2, b[k]), (2, b[k] + b[k + 2] - 1)], key=lambda e: e[1])
        if ends[1][1] == ends[2][1] or ends[0][0] == ends[1][0]:
            return 0.0
        out.append(ends[2][1] - ends[1][1] + 1)
    return out[0] * out[1] / (a[2] * a[3])


def test_boxes_equal_sorted_ends(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(int(x) for x in (*rng.integers(0, 9, 2), *rng.integers(2, 9, 2), *rng.integers(0, 9, 2), *rng.integers(2, 9, 2))) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"v{i} int" for i in range(8)))
    got = df.select("*", image.overlap([F.col(f"v{i}") for i in range(4)], [F.col(f"v{i}") for i in range(4, 8)]).alias("o")).collect()
    for r in got:
        assert r["o"]["first"] == pytest.approx(brute_box(r[:4], r[4:8]))


@pytest.mark.parametrize(("a", "b"), [(7, 9), (9, 7), (0, 5), (2147483646, 3), (2147483645, 2147483646)])
def test_pair_ids(spark, a, b):
    df = one(spark, a=a, b=b).select(image.pair_id(F.col("a"), F.col("b")).alias("p"))
    first, second = image.pair_of(F.col("p"))
    assert df.select("p", first, second).first()[:] == (min(a, b) * (2**31 - 1) + max(a, b), min(a, b), max(a, b))


def test_values(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(image.scale_to_byte(F.lit(5.0), F.lit(1.0), F.lit(5.0))) == 255 and f(image.scale_to_byte(F.lit(5.0), F.lit(5.0), F.lit(5.0))) is None
    assert f(image.color_index(F.lit(9.0), F.lit(0.0), F.lit(2.0))) == 196 and f(image.color_index(F.lit(-1.0), F.lit(0.0), F.lit(2.0))) == 0
    assert f(image.void_nodata(F.lit(-10000.05), -10000.0)) is None and f(image.void_nodata(F.lit(-10001.0), -10000.0)) == -10001.0


def test_names(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    p = f(names.product_parts(F.lit("/d/14DEC14141632-P1BS-500171606160_05_P005.NTF")))
    assert tuple(p) == ("14DEC14141632-P1BS-500171606160_05_P005", "500171606160_05", "500171606160_05_P005")
    assert f(names.product_parts(F.lit("nothing here"))) is None
    assert f(names.clean_text(F.lit("a​b\n\x07c d"))) == "abc d"
    assert f(names.numbers(F.lit(" 1  -2e3 x "))) == [1.0, -2000.0, None]
    assert tuple(f(names.utm_zone(F.lit("WGS 84 / UTM zone 21S")))) == (21, "S") and f(names.utm_zone(F.lit("none"))) is None
    assert f(names.stem(F.lit("/a/b.c.NTF"))) == "b.c" and math.isclose(f(image.gamma(F.lit(1.0))), 1.0)
