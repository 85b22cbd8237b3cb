"""Queries on tracks, keypoints and match graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import image
from ..operators import sparse
from .common import CAMERA_SQL, cameras, query, r, table


def _model(spark, d):
    """Orders as points, suppliers as images, lines as observations: both sides with their arrays."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("int").alias("image_id"), "l_quantity", F.col("l_partkey").cast("double").alias("v"), "l_discount", "l_extendedprice")
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber")) - 1)
    images = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("l_quantity").alias("x"), F.col("v").alias("y"), F.col("l_orderkey").alias("point3d_id")))).alias("p"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("image_id"), F.col("s_name").alias("name"))
    images = images.join(names, "image_id").select("image_id", "name", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["point3d_id"].alias("point3d_id"))).alias("points2d"))
    track = F.sort_array(F.collect_list(F.struct("l_linenumber", "image_id", F.col("idx").alias("point2d_idx"))))
    points = rows.groupBy(F.col("l_orderkey").alias("point3d_id")).agg(F.transform(track, lambda t: F.struct(t["image_id"].alias("image_id"), t["point2d_idx"].alias("point2d_idx"))).alias("track"), F.max("l_extendedprice").alias("x"), F.max("l_discount").alias("y"), F.max("l_quantity").alias("z"), F.max("l_discount").alias("error"))
    return points, images


def _text(c: str):
    return F.col(c).cast("long").cast("string")


@query("""SELECT l_orderkey AS point3d_id, string_agg(s_name || ':' || l_quantity::BIGINT || ':' || l_partkey, ';' ORDER BY s_name, l_quantity, l_partkey) AS pixels, count(*)::BIGINT AS n
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def track_pixels(spark, d):
    obs = sparse.observations(*_model(spark, d)).where("consistent")
    out = sparse.track_pixels(obs)
    text = F.transform("pixels", lambda p: F.concat_ws(":", p["img"], p["u"].cast("long").cast("string"), p["v"].cast("long").cast("string")))
    return out.select("point3d_id", F.array_join(text, ";").alias("pixels"), F.size("pixels").cast("long").alias("n"))


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
          SELECT s_name AS img, md5(string_agg(l_quantity::BIGINT || ':' || l_partkey || ':' || n, ';' ORDER BY l_quantity, l_partkey, n)) AS keypoints, count(*)::BIGINT AS n
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN t USING (l_orderkey) GROUP BY 1""")
def view_keypoints(spark, d):
    obs = sparse.observations(*_model(spark, d)).select("img", "u", "v", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), "track_len")
    out = sparse.view_keypoints(obs)
    text = F.transform("keypoints", lambda p: F.concat_ws(":", p["u"].cast("long").cast("string"), p["v"].cast("long").cast("string"), p["track_len"].cast("string")))
    return out.select("img", F.md5(F.array_join(text, ";").cast("binary")).alias("keypoints"), F.size("keypoints").cast("long").alias("n"))


_OBS = "o AS (SELECT l_suppkey, l_orderkey, abs(l_discount - l_tax) * 10 AS err, count(*) OVER (PARTITION BY l_orderkey) AS track_len FROM lineitem)"


def _observed(spark, d):
    rows = table(spark, d, "lineitem")
    n = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("track_len"))
    return rows.join(n, "l_orderkey").select("l_suppkey", "l_orderkey", (F.abs(F.col("l_discount") - F.col("l_tax")) * 10).alias("err"), "track_len")


@query(f"WITH {_OBS} SELECT l_suppkey, count(*)::BIGINT AS n, round(avg(err), 6) + 0 AS mean_err, round(median(err), 6) + 0 AS median_err, round(avg(track_len), 6) + 0 AS mean_len, median(track_len) AS median_len FROM o GROUP BY 1")
def view_stats(spark, d):
    out = sparse.view_stats(_observed(spark, d), ["l_suppkey"])
    return out.select("l_suppkey", "n", r("mean_err").alias("mean_err"), r("median_err").alias("median_err"), r("mean_len").alias("mean_len"), "median_len")


@query("""WITH p AS (SELECT l_orderkey, max(l_discount) AS error, count(*) AS track_len FROM lineitem GROUP BY 1)
          SELECT min(error) AS min_error, round(avg(error), 6) + 0 AS mean_error, median(error) AS median_error, max(error) AS max_error,
                 min(track_len)::BIGINT AS min_track_len, round(avg(track_len), 6) + 0 AS mean_track_len, median(track_len) AS median_track_len, max(track_len)::BIGINT AS max_track_len FROM p""")
def track_stats(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("error"), F.count(F.lit(1)).alias("track_len"))
    out = sparse.track_stats(p)
    return out.select(*[(r(c) if c.startswith("mean") else F.col(c)).alias(c) for c in out.columns])


@query(f"""WITH {CAMERA_SQL}, o AS (SELECT l_orderkey, l_linenumber, s_nationkey AS k, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z, l_tax * 4000 AS u, l_linenumber * 60.0::DOUBLE AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
           a AS (SELECT o.*, fx, fy, cx, cy, s, r11 * x + r12 * y + r13 * z + tx AS lx, r21 * x + r22 * y + r23 * z + ty AS ly, r31 * x + r32 * y + r33 * z + tz AS lz FROM o JOIN cam USING (k))
           SELECT l_orderkey, l_linenumber, round(u, 2) + 0 AS u, round(lz, 6) + 0 AS depth, round(sqrt(power((fx * lx + s * ly + cx * lz) / lz - u, 2) + power((fy * ly + cy * lz) / lz - v, 2)), 4) + 0 AS err FROM a""")
def reprojection_error(spark, d):
    """Lines as points that their supplier's nation sees: depth along the axis and distance of pixel and projection."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("k"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("img"))
    rows = table(spark, d, "lineitem").join(s, "l_suppkey").join(names, "k")
    obs = rows.select("l_orderkey", "l_linenumber", "img", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"), (F.col("l_tax") * 4000).alias("u"), (F.col("l_linenumber") * 60.0).alias("v"))
    out = sparse.reprojection(obs, cameras(spark, d).select("img", "camera"))
    return out.select("l_orderkey", "l_linenumber", r("u", 2).alias("u"), r("depth").alias("depth"), r("err", 4).alias("err"))


def _pairs(spark, d):
    """Two suppliers of one order: a match of two images. An order has a few lines, so pairs stay linear."""
    seen = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("long").alias("k"))
    per = seen.repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    each = per.select("ks", F.posexplode("ks").alias("i", "a")).select("a", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("b"))
    return each.groupBy(image.pair_id(F.col("a"), F.col("b")).alias("pair_id")).agg(F.count(F.lit(1)).alias("n"))


_PAIRS = """s AS (SELECT DISTINCT l_orderkey, l_suppkey AS k FROM lineitem),
    e AS (SELECT a.k AS i, b.k AS j, count(*)::BIGINT AS n FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.k <> b.k GROUP BY 1, 2)"""


@query(f"WITH {_PAIRS} SELECT i::BIGINT AS src, j::BIGINT AS dst, n FROM e")
def match_graph(spark, d):
    return sparse.match_graph(_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT a.s_suppkey::BIGINT AS src, b.s_suppkey::BIGINT AS dst, coalesce(e.n, 0)::BIGINT AS n FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey LEFT JOIN e ON e.i = a.s_suppkey AND e.j = b.s_suppkey")
def match_matrix(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    return sparse.match_matrix(nodes, sparse.match_graph(_pairs(spark, d)), "k")
