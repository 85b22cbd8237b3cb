import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrid.operators import depth, fit, meta, raster, robust, sparse


def cells(spark, grid):
    rows = [(i, j, float(v)) for i, r in enumerate(grid) for j, v in enumerate(r) if v is not None]
    return spark.createDataFrame(rows, "row int, col int, z double")


def as_grid(df, rows, cols):
    out = [[None] * cols for _ in range(rows)]
    for r in df.collect():
        out[r["row"]][r["col"]] = r["z"]
    return out


def some_grid(seed, rows, cols, voids):
    rng = random.Random(seed)
    return [[None if rng.random() < voids else float(rng.randrange(100)) for _ in range(cols)] for _ in range(rows)]


@pytest.mark.parametrize(("rows", "cols", "voids"), [(9, 7, 0.4), (1, 1, 0), (1, 6, 0.3), (6, 1, 0.3), (5, 5, 1.0), (8, 8, 0.0)])
def test_hole_fill_and_median_equal_loops(spark, rows, cols, voids):
    g = some_grid(rows * cols, rows, cols, voids)
    near = lambda i, j: [g[a][b] for a in range(max(0, i - 1), min(rows, i + 2)) for b in range(max(0, j - 1), min(cols, j + 2)) if g[a][b] is not None]
    want = [[g[i][j] if g[i][j] is not None else (statistics.median(near(i, j)) if near(i, j) else None) for j in range(cols)] for i in range(rows)]
    df = cells(spark, g)
    assert as_grid(raster.hole_fill(df, rows, cols), rows, cols) == want
    edge = lambda i, j: [v for a in (-1, 0, 1) for b in (-1, 0, 1) if (v := g[min(rows - 1, max(0, i + a))][min(cols - 1, max(0, j + b))]) is not None]
    want = [[None if g[i][j] is None else statistics.median(edge(i, j)) for j in range(cols)] for i in range(rows)]
    assert as_grid(raster.median3x3(df, rows, cols), rows, cols) == want
    assert raster.densify(df, rows, cols).count() == rows * cols


def test_windows_scan_their_source_once(spark, tmp_path):
    path = f"{tmp_path}/cells"
    cells(spark, some_grid(1, 9, 9, 0.5)).write.parquet(path)
    df = spark.read.parquet(path)
    for out in (raster.hole_fill(df, 9, 9), raster.median3x3(df, 9, 9), robust.mad_fuse(df, ["row", "col"], "z")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "BatchEvalPython" not in plan


def test_grid_max_edges(spark):
    pts = spark.createDataFrame([(0.0, 10.0, 1.0), (0.0, 10.0, 3.0), (4.99, 5.01, 2.0), (5.0, 9.0, 7.0), (-0.1, 9.0, 8.0), (1.0, 10.1, 9.0), (1.0, 5.0, 4.0), (1.5, 9.5, float("nan"))], "e double, n double, z double")
    row, col = raster.cell_of(F.col("e"), F.col("n"), 0.0, 10.0, 1.0, 1.0)
    got = {(r["row"], r["col"]): r["z"] for r in raster.grid_max(pts, [], row, col, F.col("z"), 5, 5).collect()}
    assert got == {(0, 0): 3.0, (4, 4): 2.0}


def test_mad_fuse(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0), ("b", 9.0), ("c", 1.0), ("c", 2.0), ("c", 3.0), ("c", 30.0), ("d", 4.0), ("d", None), ("d", 4.0), ("e", 1.0), ("e", 2.0), ("e", 3.0)]
    df = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(rows)], "row string, view int, z double")
    got = {r["row"]: (r["z"], r["n"]) for r in robust.mad_fuse(df, ["row"], "z").collect()}
    # two views: left out; deviation 0: the median's own; just at the deviation: kept
    assert got.keys() == {"b", "c", "e"} and got["b"] == (5.0, 3) and got["e"] == (2.0, 3) and got["c"][1] == 4
    vals = [1.0, 2.0, 3.0, 30.0]
    med = statistics.median(vals)
    mad = statistics.median([abs(v - med) for v in vals])
    assert got["c"][0] == pytest.approx(statistics.mean([v for v in vals if abs(v - med) <= mad]))


@pytest.mark.parametrize("n", [1, 2, 49, 50, 51, 100])
def test_index_percentiles(spark, n):
    vals = [float(i + 1) for i in range(n)]
    df = spark.createDataFrame([("a", v) for v in [*vals, -5.0, 0.0]] + [("b", -1.0)], "img string, depth double")
    got = robust.index_percentile_range(df, ["img"], "depth").collect()
    assert [tuple(r) for r in got] == [("a", vals[int(0.02 * n)] - 10, vals[int(0.98 * n)] + 30)]


@pytest.mark.parametrize("most", [5, 100_000])
def test_global_order_statistics(spark, monkeypatch, most):
    rng = np.random.default_rng(most)
    x = np.concatenate([rng.normal(50, 20, 3000), np.full(2000, 7.0), [-3.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "depth double").union(spark.createDataFrame([(None,)], "depth double"))
    shares = [0.0, 0.01, 0.3, 0.5, 0.995, 1.0]
    assert robust.global_percentiles(df, "depth", shares, most) == pytest.approx(np.percentile(x, [100 * p for p in shares]).tolist())
    monkeypatch.setattr(robust, "MOST_SORTED", most)
    pos = np.sort(x[x > 0])
    assert tuple(robust.index_percentile_range(df, [], "depth").first()) == (pos[int(0.02 * len(pos))] - 10, pos[int(0.98 * len(pos))] + 30)
    none = df.where("depth < -99")
    assert robust.global_percentiles(none, "depth", [0.5]) == [None] and tuple(robust.index_percentile_range(none, [], "depth").first()) == (None, None)


def test_percentiles_and_histogram_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(2, 2, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    p = robust.percentiles(df, [], "v", {"a": 0.01, "b": 0.995}).first()
    assert tuple(p) == pytest.approx(tuple(np.percentile(x, [1, 99.5])))
    n, _ = np.histogram(np.clip(x, 0, 4), 50, density=True)
    got = {r["bin"]: r["density"] for r in robust.histogram(df, "v", 50, 0.0, 4.0).collect()}
    assert [got.get(i, 0.0) for i in range(50)] == pytest.approx(n.tolist())
    same = robust.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", 5).collect()
    assert [(r["bin"], r["n"]) for r in same] == [(0, 2)]


def test_tone_map_and_blank(spark):
    v = [0, 0, 5, 80, 900, 2000, 2047, 12]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("b", 0, 3), ("b", 1, 3)], "img string, i int, v int")
    got = {(r["img"], r["i"]): r["byte"] for r in raster.tone_map(df, ["img"], "v").collect()}
    g = np.power(np.array(v, float), 1 / 2.2)
    lo, hi = np.percentile(g, [0.5, 99.5])
    want = (255 * (np.clip(g, lo, hi) - lo) / (hi - lo) + 1e-9).astype(int).tolist()
    assert [got["a", i] for i in range(len(v))] == want and got["b", 0] is None
    assert {r["img"]: r["blank_ratio"] for r in raster.blank_ratio(df, ["img"], F.col("v")).collect()} == {"a": 0.25, "b": 0.0}


def test_stamp_equals_loops(spark):
    pts = [(0.5, 0.5), (19.9, 9.9), (50.0, 3.0), (7.0, 7.0), (8.0, 7.0), (-3.0, 4.0)]
    df = spark.createDataFrame([("a", x, y) for x, y in pts], "img string, u double, v double")
    got = {(r["row"], r["col"]) for r in raster.stamp(df, ["img"], F.col("u"), F.col("v"), 2, F.lit(20), F.lit(10)).collect()}
    want = {(r, c) for x, y in pts for r in range(int(np.floor(y)) - 2, int(np.floor(y)) + 3) for c in range(int(np.floor(x)) - 2, int(np.floor(x)) + 3) if 0 <= r < 10 and 0 <= c < 20}
    assert got == want


def test_warp_and_crop(spark):
    g = some_grid(3, 6, 8, 0.0)
    pic = cells(spark, g).withColumnRenamed("z", "value")
    same = {(r["row"], r["col"]): r["value"] for r in raster.warp(pic, [[1, 0, 0], [0, 1, 0], [0, 0, 1]], 6, 8).collect()}
    assert same == {(i, j): g[i][j] for i in range(6) for j in range(8)}
    half = {(r["row"], r["col"]): r["value"] for r in raster.warp(pic, [[1, 0, 0.5], [0, 1, -1], [0, 0, 1]], 6, 8, border=9.0).collect()}
    at = lambda i, j: g[i][j] if 0 <= i < 6 and 0 <= j < 8 else 9.0
    assert half == pytest.approx({(i, j): (at(i - 1, j) + at(i - 1, j + 1)) / 2 for i in range(6) for j in range(8)})
    assert as_grid(raster.crop(cells(spark, g), 1, 2, 3, 4), 3, 4) == [row[2:6] for row in g[1:4]]


def scene(rng, n=200):
    k = np.array([[1200.0, 3, 640], [0, 1100, 480], [0, 0, 1]])
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    t = np.array([1.0, -2.0, 60.0])
    xyz = rng.uniform(-10, 10, (n, 3))
    p = (xyz @ q.T + t) @ k.T
    return k, q, t, xyz, p[:, :2] / p[:, 2:]


def test_dlt_recovers_cameras(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for cam in range(3):
        k, r, t, xyz, uv = scene(rng)
        want[cam] = (k, r, t)
        rows += [(cam, *map(float, x), *map(float, p)) for x, p in zip(xyz, uv)]
    rows += [(9, 1.0, 2.0, float(i), 3.0, 4.0) for i in range(5)]
    got = {r["img"]: r for r in fit.dlt_fit(spark.createDataFrame(rows, "img int, x double, y double, z double, col double, row double"), "img").collect()}
    for cam, (k, r, t) in want.items():
        assert np.array(got[cam]["k"]).reshape(3, 3) == pytest.approx(k, abs=1e-5)
        assert np.array(got[cam]["r"]).reshape(3, 3) == pytest.approx(r, abs=1e-8) and got[cam]["t"] == pytest.approx(t, abs=1e-6)
    assert got[9]["k"] is None and got[9]["n"] == 5


def test_affine_equals_lstsq_and_is_null_for_planes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3)) * [5, 50, 1] + [100, -20, 7]
    uv = x @ rng.normal(size=(3, 2)) + [3, 4] + rng.normal(size=(80, 2)) * 0.1
    rows = [("a", *map(float, p), *map(float, q)) for p, q in zip(x, uv)] + [("b", float(i), float(i), 1.0, 2.0, 3.0) for i in range(9)]
    got = {r["k"]: r["p"] for r in fit.affine_fit(spark.createDataFrame(rows, "k string, x double, y double, z double, col double, row double"), ["k"]).collect()}
    want = np.linalg.lstsq(np.c_[x, np.ones(80)], uv, rcond=None)[0].T.ravel()
    assert got["a"] == pytest.approx(want.tolist(), rel=1e-6) and got["b"][0] is None


def test_align3d(spark):
    rng = np.random.default_rng(1)
    a, m, t = rng.normal(size=(40, 3)), rng.normal(size=(3, 3)), np.array([1.0, 2, 3])
    b = a @ m.T + t
    df = spark.createDataFrame([(0, *map(float, p), *map(float, q)) for p, q in zip(a, b)] + [(1, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0)], "k int, x double, y double, z double, x2 double, y2 double, z2 double")
    got = {r["k"]: r for r in fit.align3d_fit(df, "k").collect()}
    assert got[0]["m"] == pytest.approx(m.ravel().tolist()) and got[0]["t"] == pytest.approx(t.tolist()) and got[1]["m"] is None


def test_reparametrised_depth(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{i % 3}", float(z), float(d), i % 4, 4) for i, (z, d) in enumerate(zip(rng.uniform(0, 50, 240), rng.uniform(-5, 400, 240)))]
    obs = spark.createDataFrame(rows, "img string, z double, depth double, place int, track_len int").withColumn("w", F.col("depth"))
    got = depth.reparametrised(obs, obs)
    zref = np.percentile([r[1] for r in rows], 1) - 20
    last = {r["img"]: r["last_row"] for r in got["last_rows"].collect()}
    for v in ("v0", "v1", "v2"):
        ds = sorted(d for img, _, d, _, _ in rows if img == v and d > 0)
        low = ds[int(0.02 * len(ds))] - 10
        assert last[v] == pytest.approx([0, 0, low, -low * zref])
        plane = sorted(p for img, z, d, _, _ in rows if img == v and (p := low * (z - zref) / d) > 0)
        r = got["reparam"].where(F.col("img") == v).first()
        assert (r["depth_min"], r["depth_max"]) == pytest.approx((plane[int(0.02 * len(plane))] - 10, plane[int(0.98 * len(plane))] + 30))
    lows = {v: last[v][2] for v in last}
    ends = sorted(p for v, z, d, place, n in rows if place == n - 1 and (p := lows[v] * (z - zref) / d) > 0)
    assert tuple(depth.common_range(got["obs"]).first()) == pytest.approx((ends[int(0.02 * len(ends))] - 10, ends[int(0.98 * len(ends))] + 100))
    plan = got["ranges"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_sparse_joins(spark):
    images = spark.createDataFrame([(1, "b.png", [(1.0, 2.0, 7), (3.0, 4.0, -1)]), (2, "a.png", [(5.0, 6.0, 7), (9.0, 9.0, 8)])], "image_id int, name string, points2d array<struct<x: double, y: double, point3d_id: long>>")
    points = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 0.5, [(1, 0), (2, 0)]), (8, 1.0, 1.0, 1.0, 0.1, [(2, 0)])], "point3d_id long, x double, y double, z double, error double, track array<struct<image_id: int, point2d_idx: int>>")
    obs = sparse.observations(points, images)
    assert sorted((r["point3d_id"], r["img"], r["u"], r["consistent"], r["place"]) for r in obs.collect()) == [(7, "a.png", 5.0, True, 1), (7, "b.png", 1.0, True, 0), (8, "a.png", 5.0, False, 0)]
    pix = {r["point3d_id"]: [tuple(p) for p in r["pixels"]] for r in sparse.track_pixels(obs).collect()}
    assert pix[7] == [("a.png", 5.0, 6.0), ("b.png", 1.0, 2.0)]
    found, missing = sparse.strict_lookup(images.select("image_id"), spark.createDataFrame([(1, "x")], "image_id int, y string"), "image_id")
    assert found.count() == 1 and missing.count() == 1


def test_reprojection_is_zero_for_exact_pixels(spark):
    rng = np.random.default_rng(5)
    k, _, t, _, _ = scene(rng)
    xyz = rng.uniform(-5, 5, (30, 3))
    p = (xyz + t) @ k.T
    rows = [("a", *map(float, p[i, :2] / p[i, 2]), *map(float, xyz[i]), 3) for i in range(30)]
    cam = [1280.0, 960.0, k[0, 0], k[1, 1], k[0, 2], k[1, 2], k[0, 1], 1.0, 0.0, 0.0, 0.0, *t.tolist()]
    obs = spark.createDataFrame(rows, "img string, u double, v double, x double, y double, z double, track_len int")
    out = sparse.reprojection(obs, spark.createDataFrame([("a", [float(c) for c in cam])], "img string, camera array<double>"))
    s = sparse.view_stats(out, ["img"]).first()
    assert s["n"] == 30 and s["mean_err"] == pytest.approx(0, abs=1e-9) and s["median_len"] == 3


def test_match_graph_is_symmetric(spark):
    from terragrid.functions.image import pair_id

    pairs = spark.createDataFrame([(1, 2, 5), (3, 1, 2), (2, 1, 1), (2, 3, 0)], "a long, b long, n long").select(pair_id(F.col("a"), F.col("b")).alias("pair_id"), "n")
    g = {(r["src"], r["dst"]): r["n"] for r in sparse.match_graph(pairs).collect()}
    assert g == {(1, 2): 6, (2, 1): 6, (1, 3): 2, (3, 1): 2}
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    m = {(r["src"], r["dst"]): r["n"] for r in sparse.match_matrix(nodes, sparse.match_graph(pairs), "k").collect()}
    assert len(m) == 6 and m[2, 3] == 0 and m[1, 2] == 6


def test_match_matrix_shuffles_edges_only(spark):
    """Pairs of nodes come out after the last shuffle, sort and join by key; odd nodes and edges as by a left join."""
    keys = [5, 3, 3, None, 9, -7, *range(100, 130)]
    edges = [(5, 3, 4), (3, 5, 4), (9, -7, 1), (9, -7, 2), (-7, 9, None), (129, 5, 8), (5, 129, 8), (5, 77, 6), (77, 5, 6), (9, 9, 3), (None, 5, 1), (100, 101, 0)]
    nodes = spark.createDataFrame([(k,) for k in keys], "k long")
    graph = spark.createDataFrame(edges, "src long, dst long, n long")
    want = []
    for a in keys:
        for b in keys:
            if a is not None and b is not None and a != b:
                want += [(a, b, n or 0) for x, y, n in edges if (x, y) == (a, b)] or [(a, b, 0)]
    text = sparse.match_matrix(nodes, graph, "k")._jdf.queryExecution().executedPlan().toString()
    above = text.split("BroadcastNestedLoopJoin")[0]
    assert "Exchange" not in above and "Sort" not in above and "HashJoin" not in above
    for out in (sparse.match_matrix(nodes, graph, "k"), sparse.match_matrix(nodes, graph, "k", pairs_a_task=20)):
        assert sorted(map(tuple, out.collect())) == sorted(want)
    none = nodes.where("false")
    assert sparse.match_matrix(none, graph, "k").collect() == []
    assert sorted(map(tuple, sparse.match_matrix(nodes.where("k IN (5, 9)"), graph.where("false"), "k").collect())) == [(5, 9, 0), (9, 5, 0)]
    many = sparse.match_matrix(spark.range(300).withColumnRenamed("id", "k"), graph, "k", pairs_a_task=1000)
    assert many.count() == 300 * 299 and many.agg(F.sum("n")).first()[0] == 36


def test_match_graph_of_odd_pairs(spark):
    """A pair of one image counts both ways in one row; the larger id may stand first; pairs without an id stay one row."""
    big = 2147483646
    pairs = spark.createDataFrame([(4 * 2147483647 + 4, 3), (9 * 2147483647 + 2, 1), (2 * 2147483647 + 9, 5), (None, 2), (1 * 2147483647 + big, 7), ((big - 1) * 2147483647 + big, 6), (3, None)], "pair_id long, n long")
    got = [tuple(r) for r in sparse.match_graph(pairs).collect()]
    want = [(4, 4, 6), (2, 9, 6), (9, 2, 6), (None, None, 4), (1, big, 7), (big, 1, 7), (big - 1, big, 6), (big, big - 1, 6)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_task_holds_all_rows(spark):
    """Statistics of all rows, and chronology without keys: one partition gets partial aggregates or a row for each range, never the rows."""
    rng = np.random.default_rng(6)
    n = 3000
    x, t = rng.normal(size=n), rng.integers(0, 500, n)
    df = spark.createDataFrame(list(zip(x.tolist(), t.tolist(), [f"n{i:05d}" for i in rng.permutation(n)])), "error double, track_len long, name string").repartition(5)
    s = sparse.track_stats(df).first()
    assert s[:] == pytest.approx((x.min(), x.mean(), np.median(x), x.max(), t.min(), t.mean(), np.median(t), t.max()))
    first = df.withColumn("track_len", F.when(F.col("track_len") > 3, F.col("track_len")))
    out = meta.chronological(first, "track_len", "name")
    want = sorted(first.collect(), key=lambda r: (r["track_len"] is not None, r["track_len"] or 0, r["name"]))
    assert [r["name"] for r in out.orderBy("idx").collect()] == [r["name"] for r in want]
    assert meta.chronological(df.where("false"), "track_len", "name").count() == 0
    got = sparse.camera_error(df.withColumn("k", F.col("track_len") % 3), ["k"], F.col("error"), F.col("track_len"))
    for r in got.collect():
        own = x[t % 3 == r["k"]]
        assert (r["mean_proj"], r["median_proj"], r["max_proj"]) == pytest.approx((own.mean(), np.median(own), own.max()))
        assert r["median_inv"] == np.median(t[t % 3 == r["k"]])
    for plan in (out, got):
        text = plan._jdf.queryExecution().executedPlan().toString()
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "SinglePartition" in line:
                below = "\n".join(lines[i + 1 : i + 3])
                assert "HashAggregate" in below and "error" not in below  # sizes of ranges, not rows
        assert "percentile(" not in text


def test_medians_of_odd_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", None), ("c", 7.0)], "k string, v double")
    got = {r["k"]: (r["m"], r["n"]) for r in robust.summaries(df, ["k"], {"m": "v"}, [F.count("v").alias("n")]).collect()}
    assert got == {"a": (2.5, 2), "b": (None, 0), "c": (7.0, 1)}
    assert robust.summaries(df.where("false"), [], {"m": "v"}, [F.count("v").alias("n")]).first()[:] == (0, None)


def test_metadata(spark):
    df = spark.createDataFrame([("b", 2, 0.5), ("a", 2, 0.51), ("c", 1, None)], "name string, t int, cloud double")
    assert {r["name"] for r in meta.cloud_filter(df, F.col("cloud")).collect()} == {"b"}
    assert {r["name"]: r["idx"] for r in meta.chronological(df, "t", "name").collect()} == {"c": 0, "a": 1, "b": 2}
    box = meta.rounded_box(spark.createDataFrame([(0.5, 1.5), (2.5, -2.5)], "c double, r double"), [], F.col("c"), F.col("r")).first()
    assert tuple(box) == (0, -2, 3, 5)
    steps = spark.createDataFrame([("x", True, 2.0), ("x", False, 9.0), ("y", True, 1.0)], "step string, has_run boolean, minutes double")
    assert {r["step"]: (r["n_run"], r["minutes"]) for r in meta.step_report(steps).collect()} == {"x": (1, 2.0), "y": (1, 1.0), "total": (2, 3.0)}
