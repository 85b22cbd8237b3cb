"""Queries on sources and sinks: rows written in a format into the shared folder, and what reading the files gives back.

The files are made of the tables by the library's own writers (or, for formats that it only reads, by
small writers here), so the SQL forms say what must come back from the tables alone.
"""

from __future__ import annotations

import io
import tarfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import image
from ..operators import raster, robust, sparse
from ..sources import database, dense_map, files, geotiff, image_meta, images, ply, reports, sparse_model
from .common import query, r, table
from .surfaces import _stack

PARTS = 4


def _text(lines, spark, name: str) -> str:
    folder = files.scratch(spark, name)
    lines.write.text(folder)
    return folder


def _files(contents, spark, name: str) -> str:
    folder = files.scratch(spark, name)
    files.save_files(contents, folder)
    return folder


# --- sparse models


def _cameras(spark, d):
    """Nations as cameras of five parameters."""
    k = F.col("n_nationkey").cast("double")
    params = F.array(1000.5 + k, 1001 + k / 7, 400 - k, 300 + k, k / 10)
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("camera_id"), F.lit("PERSPECTIVE").alias("model"), (640 + F.col("n_nationkey")).cast("long").alias("width"), (480 + F.col("n_nationkey")).cast("long").alias("height"), params.alias("params"))


def _camera_rows(cameras):
    return cameras.select("camera_id", "model", "width", "height", *[r(F.col("params")[i], 9).alias(f"p{i}") for i in range(5)])


_CAMERAS = """SELECT n_nationkey::INT AS camera_id, 'PERSPECTIVE' AS model, (640 + n_nationkey)::BIGINT AS width, (480 + n_nationkey)::BIGINT AS height, 1000.5::DOUBLE + n_nationkey AS p0, round(1001 + n_nationkey / 7.0::DOUBLE, 9) AS p1,
    (400 - n_nationkey)::DOUBLE AS p2, (300 + n_nationkey)::DOUBLE AS p3, n_nationkey / 10.0::DOUBLE AS p4 FROM nation"""


@query(_CAMERAS)
def cameras_text(spark, d):
    return _camera_rows(sparse_model.read_cameras(spark, _text(sparse_model.camera_lines(_cameras(spark, d)), spark, "cameras")))


@query(_CAMERAS)
def cameras_binary(spark, d):
    folder = _files(sparse_model.binary_files(_cameras(spark, d).repartition(2), "cameras"), spark, "cameras")
    return _camera_rows(sparse_model.read_cameras(spark, f"{folder}/*.bin"))


def _images(spark, d):
    """Customers as images, their orders as pixels; a third of them has none."""
    own = table(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_orderkey") / 8).alias("y")).alias("p"))
    per = own.groupBy("o_custkey").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    both = table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    pixels = F.transform(F.coalesce("ps", F.expr("array()")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["o_orderkey"].cast("long").alias("point3d_id")))
    k = F.col("c_custkey").cast("double")
    q, t = F.array(F.lit(0.5), k / 64, -k / 32, F.lit(0.25)), F.array(F.col("c_acctbal").cast("double"), k / 3, F.lit(-1.0))
    kind = "array<struct<x: double, y: double, point3d_id: bigint>>"
    return both.select(F.col("c_custkey").cast("int").alias("image_id"), q.alias("q"), t.alias("t"), F.col("c_nationkey").cast("int").alias("camera_id"), F.concat("c_name", F.lit(".png")).alias("name"), pixels.cast(kind).alias("points2d"))


def _image_rows(found):
    p = F.col("points2d")
    total = lambda f: F.aggregate(p, F.lit(0.0), lambda a, x: a + x[f])
    return found.select(
        "image_id", "camera_id", "name", r(F.col("q")[1]).alias("qx"), r(F.col("t")[0]).alias("tx"), r(F.col("t")[1]).alias("ty"), F.size(p).cast("long").alias("n"),
        F.get(p, F.lit(0))["point3d_id"].alias("first"), r(total("x"), 2).alias("sum_x"), r(total("y"), 3).alias("sum_y"),
    )


_IMAGES = """SELECT c_custkey::INT AS image_id, c_nationkey::INT AS camera_id, c_name || '.png' AS name, round(c_custkey / 64.0::DOUBLE, 6) AS qx, round(c_acctbal, 6)::DOUBLE + 0 AS tx, round(c_custkey / 3.0::DOUBLE, 6) AS ty, count(o_orderkey)::BIGINT AS n,
    min(o_orderkey)::BIGINT AS first, round(coalesce(sum(o_totalprice), 0), 2)::DOUBLE AS sum_x, round(coalesce(sum(o_orderkey / 8.0::DOUBLE), 0), 3)::DOUBLE AS sum_y
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_name, c_acctbal"""


@query(_IMAGES)
def images_text(spark, d):
    lines = sparse_model.image_lines(_images(spark, d).repartition(PARTS))
    return _image_rows(sparse_model.read_images(spark, _text(lines, spark, "images")))


@query(_IMAGES)
def images_binary(spark, d):
    folder = _files(sparse_model.binary_files(_images(spark, d).repartition(PARTS), "images"), spark, "images")
    return _image_rows(sparse_model.read_images(spark, f"{folder}/*.bin"))


def _points(spark, d):
    """Orders as points, their lines as tracks."""
    line = F.struct(F.col("l_linenumber").cast("int").alias("point2d_idx"), F.col("l_suppkey").cast("int").alias("image_id"))
    per = table(spark, d, "lineitem").select("l_orderkey", line.alias("o")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("o")).alias("os"))
    both = table(spark, d, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    track = F.transform(F.coalesce("os", F.expr("array()")), lambda o: F.struct(o["image_id"].cast("int").alias("image_id"), o["point2d_idx"].cast("int").alias("point2d_idx")))
    colour = lambda n: (F.col("o_orderkey") % n).cast("smallint")
    return both.select(
        F.col("o_orderkey").cast("long").alias("point3d_id"), F.col("o_totalprice").cast("double").alias("x"), (F.col("o_custkey") / 3).alias("y"), F.lit(-0.5).alias("z"), colour(256).alias("r"), colour(7).alias("g"), colour(101).alias("b"),
        (F.col("o_custkey") / 1024).alias("error"), track.cast("array<struct<image_id: int, point2d_idx: int>>").alias("track"),
    )


def _point_rows(found):
    t = F.col("track")
    ids = F.aggregate(t, F.lit(0).cast("long"), lambda a, o: a + o["image_id"])
    return found.select("point3d_id", r("x", 2).alias("x"), r("y").alias("y"), "z", *[F.col(c).cast("int").alias(c) for c in "rgb"], r("error", 9).alias("error"), F.size(t).cast("long").alias("n"), ids.alias("sum_id"), F.get(t, F.lit(0))["point2d_idx"].alias("first"))


_POINTS = """SELECT o_orderkey::BIGINT AS point3d_id, round(o_totalprice, 2)::DOUBLE AS x, round(o_custkey / 3.0::DOUBLE, 6) AS y, -0.5::DOUBLE AS z, (o_orderkey % 256)::INT AS r, (o_orderkey % 7)::INT AS g, (o_orderkey % 101)::INT AS b,
    round(o_custkey / 1024.0::DOUBLE, 9) AS error, count(l_orderkey)::BIGINT AS n, coalesce(sum(l_suppkey), 0)::BIGINT AS sum_id, min(l_linenumber)::INT AS first
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice, o_custkey"""


@query(_POINTS)
def points_text(spark, d):
    return _point_rows(sparse_model.read_points(spark, _text(sparse_model.point_lines(_points(spark, d)), spark, "points")))


@query(_POINTS)
def points_binary(spark, d):
    folder = _files(sparse_model.binary_files(_points(spark, d).repartition(PARTS), "points3D"), spark, "points")
    return _point_rows(sparse_model.read_points(spark, f"{folder}/*.bin"))


@query("""SELECT n_nationkey::INT AS image_id, n_name || ' ' || n_nationkey AS line, (640 + n_nationkey)::BIGINT AS width, 0::BIGINT AS n_points FROM nation""")
def init_model(spark, d):
    """Cameras and poses without pixels, an empty table of points, and lines of name and identifier."""
    cams = _cameras(spark, d)
    poses = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("image_id"), F.col("n_nationkey").cast("int").alias("camera_id"), F.col("n_name").alias("name"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))).alias("q"), F.array(*map(F.lit, (0.0, 0.0, 1.0))).alias("t"))
    folder = files.scratch(spark, "init")
    sparse_model.write_init_model(cams, poses, folder)
    lines = spark.read.text(f"{folder}/img_name2id").select(F.regexp_extract("value", r"(\d+)$", 1).cast("int").alias("image_id"), F.col("value").alias("line"))
    width = sparse_model.read_cameras(spark, f"{folder}/cameras").select(F.col("camera_id").alias("image_id"), "width")
    points = spark.read.text(f"{folder}/points3D").agg(F.count(F.lit(1)).alias("n_points"))  # one row
    return lines.join(width, "image_id").crossJoin(F.broadcast(points))


@query("""SELECT 'points' AS what, count(*)::BIGINT AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'pixels', count(*)::BIGINT FROM lineitem
          UNION ALL SELECT 'views', count(DISTINCT l_suppkey)::BIGINT FROM lineitem JOIN supplier ON s_suppkey = l_suppkey UNION ALL SELECT 'keypoints', count(*)::BIGINT FROM lineitem UNION ALL SELECT 'cameras', count(*)::BIGINT FROM nation""")
def extracted(spark, d):
    """Tracks, key points, cameras as JSON and points as text."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    obs = rows.select(F.col("l_orderkey").alias("point3d_id"), F.col("s_name").alias("img"), F.col("l_quantity").alias("u"), F.col("l_partkey").alias("v"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), F.lit(1).alias("track_len"))
    points = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_totalprice").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    cams = _cameras(spark, d).select(F.col("camera_id").cast("string").alias("img"), F.col("params").alias("camera"))
    folder = files.scratch(spark, "extracted")
    sparse_model.write_extracted(obs, cams, points, folder)
    tracks, keys = spark.read.json(f"{folder}/tracks"), spark.read.json(f"{folder}/keypoints")
    count = lambda df, what, n=F.lit(1): df.agg(F.lit(what).alias("what"), F.sum(n).cast("long").alias("n"))
    out = count(spark.read.text(f"{folder}/points").where("value rlike '^[0-9.]+ 0[.]000000 0[.]000000$'"), "points")
    for part in (count(tracks, "pixels", F.size("pixels")), count(keys, "views"), count(keys, "keypoints", F.size("keypoints")), count(spark.read.json(f"{folder}/cameras"), "cameras")):
        out = out.unionByName(part)
    return out


# --- the feature database


def _database(spark, d) -> str:
    """A database for each nation: its suppliers as images, their lines as key points, matches between one and the next by key."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    line = F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").cast("float").alias("x"), F.col("l_extendedprice").cast("float").alias("y"))
    keys = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(line)).alias("ks"))
    # a task holds a nation's images, each with its key points as two arrays
    rows = s.join(keys, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "s_name", "s_nationkey", F.col("ks.x").alias("x"), F.col("ks.y").alias("y"))

    def run(pdf):
        db = database.Database()
        nation = int(pdf["s_nationkey"].iloc[0])
        camera = db.add_camera(2, 1024, 768, [1000.0, 512.0, 384.0, 0.5], camera_id=nation + 1)
        pdf = pdf.sort_values("s_suppkey")
        ids = pdf["s_suppkey"].astype(int).tolist()
        for i, name, x, y in zip(ids, pdf["s_name"], pdf["x"], pdf["y"]):
            db.add_image(name, camera, i, t=(0.0, 0.0, float(i)))
            if x is not None:
                db.add_keypoints(i, np.stack([x, y], axis=1))
        for a, b in zip(ids, ids[1:]):
            pairs = [(k, k + 1) for k in range(a % 4)]
            db.add_matches(a, b, np.array(pairs or np.zeros((0, 2))))
            db.add_two_view_geometry(b, a, np.array([(j, i) for i, j in pairs] or np.zeros((0, 2))))
        return pd.DataFrame({"path": [f"{nation}.db"], "content": [db.content]})

    return _files(rows.groupBy("s_nationkey").applyInPandas(run, "path string, content binary"), spark, "database")


@query("SELECT s_suppkey::INT AS image_id, (s_nationkey + 1)::INT AS camera_id, s_name AS name FROM supplier")
def database_images(spark, d):
    return database.read_images(spark, _database(spark, d))


@query("""WITH n AS (SELECT s_suppkey::BIGINT AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::BIGINT AS b FROM supplier)
          SELECT a * 2147483647 + b AS pair_id, a % 4 AS n, (a % 4) * (a % 4 - 1) / 2 AS sum_first, (a % 4) * (a % 4 + 1) / 2 AS sum_second, a AS src, b AS dst FROM n WHERE b IS NOT NULL AND a % 4 >= 1""")
def database_pairs(spark, d):
    found = database.read_pairs(spark, _database(spark, d))
    src, dst = image.pair_of(F.col("pair_id"))
    total = lambda c: F.aggregate(f"matches.{c}", F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    return found.select("pair_id", "n", total("first").alias("sum_first"), total("second").alias("sum_second"), src.alias("src"), dst.alias("dst"))


@query("""SELECT l_suppkey::INT AS image_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1)::INT AS idx, l_quantity::FLOAT::DOUBLE AS x, l_extendedprice::FLOAT::DOUBLE AS y
          FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def database_keypoints(spark, d):
    return database.read_keypoints(spark, _database(spark, d))


# --- depth maps, matrices, points, rasters, pictures, tables


@query("""WITH g AS (SELECT l_linenumber AS v, (l_partkey % 40)::INT AS row, (l_suppkey % 25)::INT AS col, max(l_extendedprice) AS z FROM lineitem GROUP BY ALL),
          p AS (SELECT v, i::INT AS row, j::INT AS col FROM (SELECT DISTINCT v FROM g), range(40) a(i), range(25) b(j))
          SELECT p.v || '.png' AS view, p.row, p.col, coalesce(z, 0)::FLOAT::DOUBLE AS depth FROM p LEFT JOIN g ON g.v = p.v AND g.row = p.row AND g.col = p.col""")
def dense_maps(spark, d):
    """Surfaces of the lines as depth maps, beside maps of another kind that aren't read."""

    def run(pdf):
        a = np.zeros((40, 25), "f4")
        a[pdf["row"], pdf["col"]] = pdf["z"]
        name = f"{pdf['view'].iloc[0]}.png"
        return pd.DataFrame({"path": [f"{name}.geometric.bin", f"{name}.photometric.bin"], "content": [dense_map.encode(a), dense_map.encode(a + 1)]})

    folder = _files(_stack(spark, d).groupBy("view").applyInPandas(run, "path string, content binary"), spark, "dense")
    return dense_map.read_depth_maps(spark, folder).withColumn("depth", F.col("depth").cast("double"))


@query("SELECT 'view' || n_nationkey AS view, n_nationkey / 3.0::DOUBLE AS m0, n_nationkey / 3.0::DOUBLE + 15 AS m15, round(16 * (n_nationkey / 3.0::DOUBLE) + 120, 6) AS total FROM nation")
def matrices_text(spark, d):
    k = F.col("n_nationkey") / 3
    lines = table(spark, d, "nation").select(F.concat_ws(" ", F.concat(F.lit("view"), F.col("n_nationkey").cast("string")), *[(k + i).cast("string") for i in range(16)]).alias("value"))
    got = dense_map.read_matrices(spark, _text(lines, spark, "matrices"))
    return got.select("view", F.col("m")[0].alias("m0"), F.col("m")[15].alias("m15"), r(F.aggregate("m", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_PLY = "SELECT c_acctbal::DOUBLE AS x, c_custkey / 8.0::DOUBLE AS y, (0 - c_nationkey)::DOUBLE AS z, (c_custkey % 256)::SMALLINT AS red, (c_custkey % 7)::SMALLINT AS green, 255::SMALLINT AS blue FROM customer"


def _cloud(spark, d):
    colour = lambda c: c.cast("smallint")
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_nationkey", F.col("c_acctbal").cast("double").alias("x"), (k / 8).alias("y"), (-F.col("c_nationkey")).cast("double").alias("z"), colour(k % 256).alias("red"), colour(k % 7).alias("green"), colour(F.lit(255)).alias("blue"))


@query(_PLY)
def ply_points(spark, d):
    folder = _files(ply.point_files(_cloud(spark, d).drop("c_nationkey").repartition(PARTS), comments=("customers",)), spark, "ply")
    return ply.read_points(spark, folder)


@query(_PLY)
def ply_ranges(spark, d):
    """The files read by ranges of vertices."""
    folder = _files(ply.point_files(_cloud(spark, d).drop("c_nationkey").repartition(PARTS)), spark, "ply")
    return ply.read_points_by_ranges(spark, folder, 100)


@query(_PLY)
def ply_formats(spark, d):
    """A file for each nation, in one of the format's three forms."""

    def run(pdf):
        n = int(pdf["c_nationkey"].iloc[0])
        cols = {c: ("double", pdf[c].to_numpy(float)) for c in "xyz"} | {c: ("uchar", pdf[c].to_numpy("u1")) for c in ("red", "green", "blue")}
        return pd.DataFrame({"path": [f"{n}.ply"], "content": [ply.encode(cols, ("ascii", "binary_little_endian", "binary_big_endian")[n % 3])]})

    return ply.read_points(spark, _files(_cloud(spark, d).groupBy("c_nationkey").applyInPandas(run, "path string, content binary"), spark, "ply"))


_REF = geotiff.Georef(354052.5, 6182702.0, 0.5, 0.5, 21, True)
_SURFACE = "SELECT (l_orderkey % 600)::INT AS row, (l_partkey % 400)::INT AS col, max(l_extendedprice) AS z FROM lineitem GROUP BY ALL"


def _surface(spark, d):
    return raster.grid_max(table(spark, d, "lineitem"), [], F.col("l_orderkey") % 600, F.col("l_partkey") % 400, F.col("l_extendedprice"), 600, 400)


@query(f"SELECT row, col, z::FLOAT::DOUBLE AS z FROM ({_SURFACE})")
def geotiff_surface(spark, d):
    """The surface as strips of 128 rows, read as one."""
    return geotiff.read_strips(spark, _files(geotiff.dsm_strips(_surface(spark, d), "dsm", 600, 400, _REF, 128), spark, "tiff"), _REF)


@query("""SELECT 354052.5::DOUBLE AS ul_e, 6182702.0::DOUBLE - 64 * s AS ul_n, 354252.5::DOUBLE AS lr_e, 6182702.0::DOUBLE - least(64 * s + 64, 300) AS lr_n, 0.5::DOUBLE AS e_res, 0.5::DOUBLE AS n_res,
          21 AS zone, 'S' AS hemisphere, least(128, 600 - 128 * s)::INT AS n_rows, 400 AS n_cols FROM range(5) a(s)""")
def geotiff_place(spark, d):
    return geotiff.read_georef(spark, _files(geotiff.dsm_strips(_surface(spark, d), "dsm", 600, 400, _REF, 128), spark, "tiff"))


@query("""WITH g AS (SELECT l_linenumber || '.png' AS view, (l_partkey % 40)::INT AS row, (l_suppkey % 25)::INT AS col, (max(l_orderkey) % 200)::INT AS level FROM lineitem GROUP BY ALL),
          p AS (SELECT view, i::INT AS row, j::INT AS col FROM (SELECT DISTINCT view FROM g), range(40) a(i), range(25) b(j))
          SELECT p.view, p.row, p.col, coalesce(level, 0) AS grey, coalesce(CASE WHEN level < 100 THEN 2 * level WHEN level >= 100 THEN 255 END, 0) AS red, coalesce(255 - level, 0) AS blue FROM p LEFT JOIN g ON g.view = p.view AND g.row = p.row AND g.col = p.col""")
def pictures(spark, d):
    """Levels as grey pictures and, through a colour table, as coloured ones; pixels without a line are black."""
    lines = table(spark, d, "lineitem")
    cells = lines.groupBy(F.col("l_linenumber").alias("view"), (F.col("l_partkey") % 40).cast("int").alias("row"), (F.col("l_suppkey") % 25).cast("int").alias("col")).agg((F.max("l_orderkey") % 200).cast("int").alias("value"))
    grey = images.read_pixels(spark, _files(images.picture_files(cells, 40, 25), spark, "grey")).where("band = 0")
    colours = [(2 * i if i < 100 else 255, 0, 255 - i) for i in range(200)]
    colour = images.read_pixels(spark, _files(images.picture_files(cells, 40, 25, colours=colours), spark, "colour"))
    bands = colour.groupBy("view", "row", "col").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).cast("int").alias(n) for b, n in ((2, "red"), (0, "blue"))])
    return grey.select("view", "row", "col", F.col("value").cast("int").alias("grey")).join(bands, ["view", "row", "col"])


@query("SELECT p_size::DOUBLE AS size, p_retailprice::DOUBLE AS price, CASE WHEN p_partkey % 5 > 0 THEN p_partkey / 3.0::DOUBLE END AS share FROM part")
def number_table(spark, d):
    """White-space separated numbers under a header; what is no number is null."""
    third = F.when(F.col("p_partkey") % 5 > 0, (F.col("p_partkey") / 3).cast("string")).otherwise("none")
    lines = table(spark, d, "part").select(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("\t "), F.col("p_retailprice").cast("string"), F.lit("  "), third).alias("value"))
    head = spark.range(1).select(F.lit("# size price share").alias("value"))
    return images.read_table(spark, _text(head.unionByName(lines), spark, "table"), ["size", "price", "share"])


# --- image metadata


def _xml(spark, d):
    """Nations as metadata files; those of one sensor in four aren't supported."""
    k = F.col("n_nationkey")
    number = lambda c: c.cast("string")
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    angles = [tag(p, number(k / 50 if n == "cloudCover" else k + i)) for i, (n, p) in enumerate(image_meta.ANGLES.items())]
    series = [tag(p.split("/")[0], tag(p.split("/")[1], F.concat_ws(" ", *[number(k + 100 * j + i / 4) for i in range(20)]))) for j, p in enumerate(image_meta.NAMES.values())]
    scalars = [tag(p, number(k + i / 8)) for i, p in enumerate(image_meta.SCALARS.values())]
    sensor = F.element_at(F.array(*map(F.lit, ("WV01", "WV02", "WV03", "QB02"))), (k % 4 + 1).cast("int"))
    when = F.date_format(F.timestamp_seconds(F.lit(1418652992) + 86400 * k), "yyyy-MM-dd'T'HH:mm:ss'.250000Z'")
    imd = tag("IMD", tag("IMAGE", tag("SATID", sensor), tag("TLCTIME", when), *angles), tag("NUMROWS", number(70 + k)), tag("NUMCOLUMNS", number(80 + k)))
    return table(spark, d, "nation").select(k.alias("k"), F.concat(F.lit("image"), number(k)).alias("name"), tag("isd", imd, tag("RPB", tag("IMAGE", *series, *scalars))).alias("xml"))


@query("""SELECT 'image' || n_nationkey AS name, (80 + n_nationkey)::INT AS width, (70 + n_nationkey)::INT AS height, n_nationkey / 50.0::DOUBLE AS cloud, 'WV0' || (n_nationkey % 4 + 1) AS sensor_id,
          n_nationkey + 200.75::DOUBLE AS col_num3, n_nationkey + 4 / 8.0::DOUBLE AS lat_off, (1418652992 + 86400 * n_nationkey)::BIGINT AS seconds, n_nationkey + 1.0::DOUBLE AS sun, (SELECT count(*) FROM nation WHERE n_nationkey % 4 = 3)::BIGINT AS n_rejected
          FROM nation WHERE n_nationkey % 4 < 3""")
def xml_metadata(spark, d):
    contents = _xml(spark, d).select(F.concat("name", F.lit(".XML")).alias("path"), F.col("xml").cast("binary").alias("content"))
    got = image_meta.read_xml(spark, _files(contents, spark, "xml"))
    bad = files.rejected(got).agg(F.count(F.lit(1)).alias("n_rejected"))  # one row
    sun = next(iter(image_meta.ANGLES))
    place = list(image_meta.ANGLES).index(sun)
    out = files.good(got).select("name", "width", "height", F.col("cloudCover").alias("cloud"), "sensor_id", F.col("rpc.colNum")[3].alias("col_num3"), F.col("rpc.latOff").alias("lat_off"), F.unix_seconds("capTime").alias("seconds"), (F.col(sun) + 1 - place).alias("sun"))
    return out.crossJoin(F.broadcast(bad))


@query("SELECT 'image' || n_nationkey AS img, 'order/DVD_VOL_' || (n_nationkey % 3 + 1) || '/order/p_PAN/image' || n_nationkey || '.XML' AS member, n_nationkey % 2 = 0 AS has_browse, CASE WHEN n_nationkey % 2 = 0 THEN 'picture ' || n_nationkey END AS browse, true AS clean, n_name AS inside FROM nation")
def tar_metadata(spark, d):
    """Archives with the metadata in a volume folder, control characters in it, other members beside it, and a browse picture in every other one."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))

    def run(batches):
        for b in batches:
            out = []
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                place = f"order/DVD_VOL_{k % 3 + 1}/order/p_PAN/image{k}"
                members = {"order/readme.txt": "x", f"order/DVD_VOL_{k % 3 + 1}/order/p_MUL/image{k}.XML": "<other/>", f"{place}.XML": f"<a>\x01{n}\n</a>"}
                if k % 2 == 0:
                    members[f"{place}-BROWSE.JPG"] = f"picture {k}"
                raw = io.BytesIO()
                with tarfile.open(fileobj=raw, mode="w") as tar:
                    for name, text in members.items():
                        info = tarfile.TarInfo(name)
                        info.size = len(text)
                        tar.addfile(info, io.BytesIO(text.encode()))
                out.append((f"image{k}.tar", raw.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out]), pa.array([c for _, c in out], pa.binary())], names=["path", "content"])

    got = image_meta.read_tar_xml(spark, _files(rows.mapInArrow(run, "path string, content binary"), spark, "tar"))
    return files.good(got).select("img", "member", "has_browse", F.col("browse").cast("string").alias("browse"), (~F.col("xml").rlike(r"[\x00-\x1f]")).alias("clean"), F.regexp_extract("xml", "<a>(.*)</a>", 1).alias("inside"))


@query("SELECT 'n' || n_nationkey AS stem FROM nation WHERE n_nationkey % 2 = 0")
def file_listing(spark, d):
    """Nations as image files, and archives beside them: the images by name, with the stems that other files are found by."""
    k = F.col("n_nationkey")
    contents = table(spark, d, "nation").select(F.concat(F.lit("n"), k.cast("string"), F.when(k % 2 == 0, ".NTF").otherwise(".tar")).alias("path"), F.lit(b"x").alias("content"))
    return image_meta.list_images(spark, _files(contents, spark, "listing")).select("stem")


@query("""SELECT r_regionkey, 21 AS zone_number, 'S' AS hemisphere, 354000.5::DOUBLE + r_regionkey AS ul_easting, 354000.5::DOUBLE + r_regionkey + 700 AS lr_easting, 6182000.25::DOUBLE - 600 AS lr_northing, true AS around, 2 AS n_dirs FROM region""")
def area_config(spark, d):
    """A run configuration for each region, its area written as JSON and read again."""
    out = None
    for k in sorted(x[0] for x in table(spark, d, "region").select("r_regionkey").collect()):  # five configurations, each a document of its own
        text = f'{{"dataset_dir": ["/a", "/b"], "work_dir": "/w", "steps_to_run": {{}}, "alt_min": -30.0, "alt_max": 120.0, "bounding_box": {{"zone_number": 21, "hemisphere": "S", "ul_easting": {354000.5 + k}, "ul_northing": 6182000.25, "width": 700.0, "height": 600.0}}}}'
        config = image_meta.read_config(text)
        row = image_meta.area(spark, config).withColumns({"r_regionkey": F.lit(k), "n_dirs": F.lit(len(config["dataset_dir"]))})
        out = row if out is None else out.unionByName(row)
    folder = files.scratch(spark, "area")
    reports.write_json(out, folder)
    back = spark.read.schema(out.schema).json(folder)
    around = (F.col("lat_min") < F.col("lat_max")) & (F.col("lon_min") < F.col("lon_max")) & F.col("lat_min").between(-34.6, -34.4) & F.col("lon_max").between(-58.7, -58.5)
    return back.select("r_regionkey", "zone_number", "hemisphere", "ul_easting", "lr_easting", "lr_northing", around.alias("around"), "n_dirs")


@query("SELECT 'image' || n_nationkey AS name, (80 + n_nationkey)::INT AS width, '2014-12-' || lpad((15 + n_nationkey % 10)::VARCHAR, 2, '0') || 'T14:16:32.250000' AS cap_time, n_nationkey + 0.5::DOUBLE AS row_off, '/out/image' || n_nationkey || '.png' AS png, '/out/image' || n_nationkey || '.json' AS json FROM nation")
def metadata_json(spark, d):
    """Each image's metadata as JSON, and the manifest of pictures and metadata."""
    k = F.col("n_nationkey")
    when = F.timestamp_micros(F.lit(1418652992250000) + 86_400_000_000 * (k % 10))
    metas = table(spark, d, "nation").select(F.concat(F.lit("image"), k.cast("string")).alias("name"), (80 + k).cast("int").alias("width"), when.alias("capTime"), F.struct((k + 0.5).alias("rowOff")).alias("rpc"))
    folder = files.scratch(spark, "metas")
    reports.write_json(metas.withColumn("capTime", F.date_format("capTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), f"{folder}/metas")
    reports.write_json(reports.image_manifest(metas, "/out"), f"{folder}/manifest")
    back = spark.read.schema("name string, width int, capTime string, rpc struct<rowOff: double>").json(f"{folder}/metas")
    manifest = spark.read.schema("png string, json string").json(f"{folder}/manifest").withColumn("name", F.regexp_extract("png", r"([^/]+)\.png$", 1))
    return back.join(manifest, "name").select("name", "width", F.col("capTime").alias("cap_time"), F.col("rpc.rowOff").alias("row_off"), "png", "json")


_BOXES = ", ".join(f"min({c}) AS {n}_min, max({c}) AS {n}_max" for n, c in (("lat", "c_custkey / 100.0::DOUBLE"), ("lon", "(0 - c_custkey) / 50.0::DOUBLE"), ("alt", "c_acctbal"), ("xx", "c_custkey::DOUBLE"), ("yy", "2.0::DOUBLE * c_custkey"), ("zz", "c_acctbal / 4")))


@query(f"""WITH b AS (SELECT {_BOXES} FROM customer)
           SELECT n_name AS img, (640 + n_nationkey)::DOUBLE AS w, n_nationkey / 3.0::DOUBLE AS a0, 1000.5::DOUBLE + n_nationkey AS fx, b.* FROM nation, b""")
def camera_json(spark, d):
    """Affine and perspective cameras as JSON objects, and the boxes of the samples that they were fitted to."""
    k = F.col("n_nationkey").cast("double")
    nations = table(spark, d, "nation")
    affine = nations.select(F.col("n_name").alias("img"), F.array(640 + k, 480 + k, *[k / 3 + i for i in range(8)]).alias("params"))
    perspective = nations.select(F.col("n_name").alias("img"), F.array(640 + k, 480 + k, 1000.5 + k, *[k / 7 + i for i in range(11)]).alias("params"))
    c = F.col("c_custkey").cast("double")
    samples = table(spark, d, "customer").select((c / 100).alias("lat"), ((0 - c) / 50).alias("lon"), F.col("c_acctbal").alias("alt"), c.alias("xx"), (2 * c).alias("yy"), (F.col("c_acctbal") / 4).alias("zz"))
    folder = files.scratch(spark, "cameras")
    reports.write_cameras(affine, perspective, samples, folder)
    read = lambda name: spark.read.text(f"{folder}/{name}").select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("img", "p"))
    one, two = read("affine_latlonalt").select("img", F.col("p")[0].alias("w"), F.col("p")[2].alias("a0")), read("perspective_enu").select("img", F.col("p")[2].alias("fx"))
    for name, cols in (("bbx_latlonalt", ("lat", "lon", "alt")), ("bbx_enu", ("xx", "yy", "zz"))):
        schema = ", ".join(f"{n}_{s} double" for n in cols for s in ("min", "max"))
        two = two.crossJoin(F.broadcast(spark.read.schema(schema).json(f"{folder}/{name}")))  # one row each
    return one.join(two, "img")


# --- reports


@query("""WITH v AS (SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY 1)
          SELECT s_suppkey::BIGINT AS view, coalesce(lo, -1e20)::DOUBLE AS depth_min, coalesce(hi, -1e20)::DOUBLE AS depth_max FROM supplier LEFT JOIN v ON l_suppkey = s_suppkey""")
def depth_range_text(spark, d):
    """Lines of name and range; views without a depth get the sentinel."""
    found = table(spark, d, "lineitem").where("l_suppkey % 5 > 0").groupBy(F.col("l_suppkey").alias("img")).agg(F.min("l_extendedprice").alias("depth_min"), F.max("l_extendedprice").alias("depth_max"))
    views = table(spark, d, "supplier").select(F.col("s_suppkey").alias("img")).join(found, "img", "left").withColumn("img", F.col("img").cast("string"))
    return images.read_table(spark, _text(reports.depth_range_lines(views), spark, "ranges"), ["view", "depth_min", "depth_max"]).withColumn("view", F.col("view").cast("long"))


@query("SELECT s_name AS line, count(*)::BIGINT AS n FROM supplier GROUP BY 1 UNION ALL SELECT '__auto__, 20', count(*)::BIGINT FROM supplier")
def matching_config(spark, d):
    views = table(spark, d, "supplier").select(F.col("s_name").alias("img"))
    return spark.read.text(_text(reports.matching_config(views), spark, "config")).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey::BIGINT AS img, round(avg(l_tax), 6) + 0 AS mean_proj, max(l_tax) AS max_proj, round(avg(l_discount), 6) + 0 AS mean_inv, max(l_discount) AS max_inv, round(median(l_tax), 6) AS median_proj, round(median(l_discount), 6) AS median_inv FROM lineitem GROUP BY 1")
def camera_report(spark, d):
    """The six errors of each camera as CSV."""
    rows = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "img")
    errors = sparse.camera_error(rows, ["img"], F.col("l_tax"), F.col("l_discount"))
    folder = files.scratch(spark, "errors")
    reports.write_camera_report(errors, folder)
    back = spark.read.option("header", True).schema(", ".join(f"{c} {'long' if c == 'img' else 'double'}" for c in errors.columns)).csv(folder)
    return back.select("img", *[(F.col(c) if c.startswith("max") else r(c)).alias(c) for c in back.columns if c != "img"])


@query("SELECT n_name AS img_name, n_nationkey / 8.0::DOUBLE - 1 AS delta_cx, -n_nationkey / 4.0::DOUBLE + 0 AS delta_cy FROM nation")
def principal_points(spark, d):
    k = F.col("n_nationkey").cast("double")
    before = table(spark, d, "nation").select(F.col("n_name").alias("img"), (320 + k).alias("cx"), (240 - k).alias("cy"))
    after = table(spark, d, "nation").select(F.col("n_name").alias("img"), (319 + k + k / 8).alias("cx"), (240 - k - k / 4).alias("cy"))
    folder = files.scratch(spark, "principal")
    reports.write_principal_points(sparse.camera_delta(before, after), folder)
    back = spark.read.option("header", True).schema("img_name string, delta_cx double, delta_cy double").csv(folder)
    return back.select("img_name", "delta_cx", (F.col("delta_cy") + 0.0).alias("delta_cy"))


@query("""WITH t AS (SELECT l_orderkey, count(*) AS track_len FROM lineitem GROUP BY 1),
          o AS (SELECT l_suppkey AS img, sqrt(l_extendedprice) AS err, track_len, l_extendedprice FROM lineitem JOIN t USING (l_orderkey))
          SELECT img::BIGINT AS img, 640::BIGINT AS w, count(*)::BIGINT AS n, round(avg(err), 4) AS mean_err, round(median(err), 4) AS median_err, sum(track_len)::BIGINT AS sum_len, median(track_len) AS median_len, round(quantile_cont(l_extendedprice, 0.01), 4) AS depth_min,
                 round(quantile_cont(l_extendedprice, 0.99), 4) AS depth_max, (img % 3)::BIGINT AS n_matches FROM o GROUP BY img""")
def inspection_text(spark, d):
    """Key points, depth ranges and matches of each view, as text, read again."""
    lines = table(spark, d, "lineitem")
    seen = lines.join(lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("track_len")), "l_orderkey").select(F.col("l_suppkey").alias("img"), F.sqrt("l_extendedprice").alias("err"), "track_len")
    stats = sparse.view_stats(seen, ["img"]).withColumns({"w": F.lit(640), "h": F.lit(480)})
    depths = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("img"), "l_extendedprice")
    ranges = robust.percentiles(depths, ["img"], "l_extendedprice", {"depth_min": 0.01, "depth_max": 0.99}).withColumn("img", F.col("img").cast("string"))
    views = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src")).distinct()
    matches = views.select("src", F.explode(F.filter(F.sequence(F.lit(1), F.lit(2)), lambda x: x <= F.col("src") % 3)).alias("dst"), F.lit(7).alias("n"))
    folder = files.scratch(spark, "inspection")
    reports.write_inspection(stats.withColumn("img", F.col("img").cast("string")), ranges, matches, folder)
    cells = lambda name: F.split("value", ", ")
    keys = spark.read.text(f"{folder}/keypoints").select(cells("value").alias("f"))
    names = ("img", "w", "h", "n", "mean_err", "median_err", "mean_len", "median_len")
    keys = keys.select(*[F.col("f")[i].cast("long" if i < 4 else "double").alias(n) for i, n in enumerate(names)])
    back = spark.read.text(f"{folder}/depth_ranges").select(cells("value").alias("f")).select(F.col("f")[0].cast("long").alias("img"), r(F.col("f")[1].cast("double"), 4).alias("depth_min"), r(F.col("f")[2].cast("double"), 4).alias("depth_max"))
    pairs = spark.read.schema("dst long, n long, src long").csv(f"{folder}/matches").groupBy(F.col("src").alias("img")).agg(F.count(F.lit(1)).alias("n_matches"))
    out = keys.join(back, "img").join(pairs, "img", "left")
    return out.select("img", "w", "n", "mean_err", "median_err", F.round(F.col("mean_len") * F.col("n")).cast("long").alias("sum_len"), "median_len", "depth_min", "depth_max", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


@query("""SELECT n_name || CASE WHEN n_nationkey % 3 = 0 THEN ', skipped' ELSE ', success, ' || (n_nationkey / 4.0::DOUBLE) END AS line FROM nation
          UNION ALL SELECT 'total: ' || sum(CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey / 4.0::DOUBLE ELSE 0 END) || ' minutes' FROM nation""")
def runtime_report(spark, d):
    k = F.col("n_nationkey")
    steps = table(spark, d, "nation").select(F.col("n_name").alias("step"), (k % 3 > 0).alias("has_run"), F.when(k % 3 > 0, k / 4).otherwise(0.0).alias("minutes"))
    folder = files.scratch(spark, "runtime")
    reports.write_runtime(steps, folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


# --- a mask


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN NOT (l_returnflag = 'R' OR l_tax > 0.05 OR l_linenumber IS NULL) THEN l_extendedprice END AS value FROM lineitem""")
def mask_or(spark, d):
    """Voids where a value lies under any mask."""
    out = image.masked(F.col("l_extendedprice"), F.col("l_returnflag") == "R", F.col("l_tax") > 0.05, F.lit(None).cast("boolean"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", out.alias("value"))
