"""Queries on rasters, surfaces and robust statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import image
from ..operators import raster, robust
from .common import long, query, r, table

ROWS, COLS = 700, 300
#: Cells of a surface with voids: order and part numbers as place, the price as height; there are more cells than lines.
_GRID = "g AS (SELECT (l_orderkey % 700)::INT AS row, (l_partkey % 300)::INT AS col, max(l_extendedprice) AS z FROM lineitem GROUP BY ALL)"
_STACK = "g AS (SELECT l_linenumber AS view, (l_partkey % 40)::INT AS row, (l_suppkey % 25)::INT AS col, max(l_extendedprice) AS z FROM lineitem GROUP BY ALL)"


def _grid(spark, d):
    return raster.grid_max(table(spark, d, "lineitem"), [], F.col("l_orderkey") % ROWS, F.col("l_partkey") % COLS, F.col("l_extendedprice"), ROWS, COLS)


def _stack(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "view")
    return raster.grid_max(rows, ["view"], F.col("l_partkey") % 40, F.col("l_suppkey") % 25, F.col("l_extendedprice"), 40, 25)


@query(f"""WITH {_STACK}, m AS (SELECT *, count(*) OVER c AS n, median(z) OVER c AS med FROM g WINDOW c AS (PARTITION BY row, col)),
           k AS (SELECT *, abs(z - med) AS dev FROM m WHERE n >= 3), s AS (SELECT *, median(dev) OVER (PARTITION BY row, col) AS mad FROM k)
           SELECT row, col, round(avg(z), 4) + 0 AS z, any_value(n)::BIGINT AS n FROM s WHERE dev <= mad GROUP BY row, col""")
def mad_fuse(spark, d):
    return robust.mad_fuse(_stack(spark, d), ["row", "col"], "z").select("row", "col", r("z", 4).alias("z"), "n")


@query("""SELECT row::INT AS row, col::INT AS col, max(l_extendedprice) AS z
          FROM (SELECT floor((5000 - l_suppkey) / 2.5::DOUBLE) AS row, floor((l_quantity * 3 - 10) / 2.5::DOUBLE) AS col, l_extendedprice FROM lineitem)
          WHERE row BETWEEN 0 AND 1999 AND col BETWEEN 0 AND 49 GROUP BY 1, 2""")
def grid_max(spark, d):
    row, col = raster.cell_of(F.col("l_quantity") * 3, F.col("l_suppkey"), 10.0, 5000.0, 2.5, 2.5)
    return raster.grid_max(table(spark, d, "lineitem"), [], row, col, F.col("l_extendedprice"), 2000, 50)


@query(f"WITH {_GRID} SELECT r.i::INT AS row, c.j::INT AS col, z FROM range(700) r(i) CROSS JOIN range(300) c(j) LEFT JOIN g ON g.row = i AND g.col = j")
def grid_dense(spark, d):
    return raster.densify(_grid(spark, d), ROWS, COLS)


@query(f"WITH {_GRID} SELECT 210000::BIGINT AS n_cells, round(1 - (SELECT count(*) FROM g) / 210000.0::DOUBLE, 6) + 0 AS void_ratio")
def void_ratio(spark, d):
    return raster.void_ratio(raster.densify(_grid(spark, d), ROWS, COLS), []).select("n_cells", r("void_ratio").alias("void_ratio"))


_OFF = "o AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j))"


@query(f"""WITH {_GRID}, {_OFF},
           f AS (SELECT g.row + i AS row, g.col + j AS col, median(z) AS z FROM g, o WHERE g.row + i BETWEEN 0 AND 699 AND g.col + j BETWEEN 0 AND 299 GROUP BY 1, 2)
           SELECT row::INT AS row, col::INT AS col, round(z, 4) + 0 AS z FROM g UNION ALL
           SELECT f.row::INT, f.col::INT, round(f.z, 4) FROM f ANTI JOIN g ON f.row = g.row AND f.col = g.col""")
def hole_fill(spark, d):
    return raster.hole_fill(_grid(spark, d), ROWS, COLS).select("row", "col", r("z", 4).alias("z"))


@query(f"""WITH {_GRID}, {_OFF}, p AS (SELECT row, col, least(699, greatest(0, row + i)) AS y, least(299, greatest(0, col + j)) AS x FROM g, o)
           SELECT p.row::INT AS row, p.col::INT AS col, round(median(g.z), 4) + 0 AS z FROM p JOIN g ON g.row = p.y AND g.col = p.x GROUP BY 1, 2""")
def median3x3(spark, d):
    return raster.median3x3(_grid(spark, d), ROWS, COLS).select("row", "col", r("z", 4).alias("z"))


@query(f"WITH {_GRID} SELECT row, col, 1000 + col * 0.5::DOUBLE AS east, 9000 - row * 0.5::DOUBLE AS north, z, 1303 AS n_rows, 1426 AS n_cols FROM g")
def cell_coords(spark, d):
    east, north = raster.cell_corner(F.col("row"), F.col("col"), 1000.0, 9000.0, 0.5, 0.5)
    rows, cols = raster.grid_size(F.lit(712.97), F.lit(651.48), 0.5)
    return _grid(spark, d).select("row", "col", east.alias("east"), north.alias("north"), "z", rows.alias("n_rows"), cols.alias("n_cols"))


@query("SELECT l_linenumber AS plane, (l_partkey % 40)::INT AS row, (l_suppkey % 25)::INT AS col, round(sum(l_extendedprice), 2) + 0 AS total, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2, 3")
def stack_mean(spark, d):
    """Mean pictures of planes; shown as the mean times the number of pictures, which has two decimals."""
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("plane"), (F.col("l_partkey") % 40).cast("int").alias("row"), (F.col("l_suppkey") % 25).cast("int").alias("col"), F.col("l_extendedprice").alias("value"))
    return raster.stack_mean(rows, ["plane"]).select("plane", "row", "col", r(F.col("mean") * F.col("n"), 2).alias("total"), "n")


@query("""SELECT DISTINCT p_brand, y::INT AS row, x::INT AS col FROM part, range(-5, 6) a(i), range(-5, 6) b(j), LATERAL (SELECT p_size * 4 + j AS x, p_partkey % 97 + i AS y)
          WHERE x BETWEEN 0 AND 179 AND y BETWEEN 0 AND 89""")
def stamp_coverage(spark, d):
    p = table(spark, d, "part")
    return raster.stamp(p, ["p_brand"], F.col("p_size") * 4, F.col("p_partkey") % 97, 5, F.lit(180), F.lit(90))


@query("""SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.01), 6) + 0 AS p1, round(quantile_cont(l_extendedprice, 0.99), 6) + 0 AS p99,
                 round(quantile_cont(l_extendedprice, 0.005), 6) + 0 AS p05, round(quantile_cont(l_extendedprice, 0.995), 6) + 0 AS p995 FROM lineitem GROUP BY 1""")
def percentile_linear(spark, d):
    out = robust.percentiles(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", {"p1": 0.01, "p99": 0.99, "p05": 0.005, "p995": 0.995})
    return out.select("l_suppkey", *[r(c).alias(c) for c in ("p1", "p99", "p05", "p995")])


@query("""WITH k AS (SELECT l_suppkey, v, row_number() OVER (PARTITION BY l_suppkey ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n
                     FROM (SELECT l_suppkey, l_extendedprice - 2000 AS v FROM lineitem) WHERE v > 0)
          SELECT l_suppkey, round(max(v) FILTER (WHERE i = floor(0.02::DOUBLE * n)) - 10, 4) + 0 AS depth_min, round(max(v) FILTER (WHERE i = floor(0.98::DOUBLE * n)) + 30, 4) + 0 AS depth_max FROM k GROUP BY 1""")
def nearest_rank_range(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") - 2000).alias("depth"))
    return robust.index_percentile_range(rows, ["l_suppkey"], "depth").select("l_suppkey", r("depth_min", 4).alias("depth_min"), r("depth_max", 4).alias("depth_max"))


@query("""WITH c AS (SELECT l_suppkey, quantile_cont(power(l_extendedprice, 1 / 2.2::DOUBLE), 0.005) AS lo, quantile_cont(power(l_extendedprice, 1 / 2.2::DOUBLE), 0.995) AS hi FROM lineitem GROUP BY 1)
          SELECT l_orderkey, l_linenumber, floor(255 * (least(greatest(power(l_extendedprice, 1 / 2.2::DOUBLE), lo), hi) - lo) / nullif(hi - lo, 0) + 1e-9)::BIGINT AS byte
          FROM lineitem JOIN c USING (l_suppkey)""")
def tone_map(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return raster.tone_map(rows, ["l_suppkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", "byte")


@query("SELECT l_suppkey, round(avg(CASE WHEN l_discount = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0 AS blank_ratio, avg(CASE WHEN l_discount = 0 THEN 1.0::DOUBLE ELSE 0 END) > 0.2::DOUBLE AS dropped FROM lineitem GROUP BY 1")
def blank_ratio(spark, d):
    out = raster.blank_ratio(table(spark, d, "lineitem"), ["l_suppkey"], F.floor(F.col("l_discount") * 100 + 0.5))
    return out.select("l_suppkey", r("blank_ratio").alias("blank_ratio"), (F.col("blank_ratio") > 0.2).alias("dropped"))


@query("""WITH b AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM (SELECT least(greatest(l_extendedprice, 2000), 80000) AS x FROM lineitem))
          SELECT least(49, floor((least(greatest(l_extendedprice, 2000), 80000) - lo) * 50 / (hi - lo)))::INT AS bin, count(*)::BIGINT AS n, round(count(*) / (any_value(b.n) * ((any_value(hi) - any_value(lo)) / 50)) * 1e6, 6) + 0 AS density
          FROM lineitem, b GROUP BY 1""")
def histogram50(spark, d):
    out = robust.histogram(table(spark, d, "lineitem"), "l_extendedprice", 50, 2000.0, 80000.0)
    return out.select("bin", "n", r(F.col("density") * 1e6).alias("density"))


@query("""WITH c AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
          SELECT least(196, floor((least(greatest(l_extendedprice, lo), hi) - lo) / (hi - lo) * 197 + 1e-9))::BIGINT AS level, count(*)::BIGINT AS n FROM lineitem, c GROUP BY 1""")
def color_index(spark, d):
    rows = table(spark, d, "lineitem").select("l_extendedprice")
    lo, hi = robust.global_percentiles(rows, "l_extendedprice", [0.01, 0.99])
    level = image.color_index(F.col("l_extendedprice"), F.lit(lo), F.lit(hi))
    return rows.groupBy(long(level).alias("level")).agg(F.count(F.lit(1)).alias("n"))


_H = [[0.9, 0.1, 2.5], [-0.05, 1.1, -3.25], [0.0005, -0.0002, 1.0]]
_SRC = ["({} * col + {} * row + {})".format(*(f"({x})::DOUBLE" for x in h)) for h in _H]


@query(f"""WITH {_GRID}, t AS (SELECT i::INT AS row, j::INT AS col FROM range(120) a(i), range(90) b(j)), s AS (SELECT row, col, {_SRC[0]} / {_SRC[2]} AS x, {_SRC[1]} / {_SRC[2]} AS y FROM t),
           f AS (SELECT *, floor(x) AS x0, floor(y) AS y0 FROM s),
           c AS (SELECT row, col, y0 + di AS sr, x0 + dj AS sc, (CASE WHEN di = 1 THEN y - y0 ELSE 1 - (y - y0) END) * (CASE WHEN dj = 1 THEN x - x0 ELSE 1 - (x - x0) END) AS share FROM f, range(2) p(di), range(2) q(dj))
           SELECT c.row, c.col, round(sum(share * coalesce(z, 0)), 4) + 0 AS value FROM c LEFT JOIN g ON g.row = sr AND g.col = sc GROUP BY 1, 2""")
def image_warp(spark, d):
    picture = _grid(spark, d).withColumnRenamed("z", "value")
    return raster.warp(picture, _H, 120, 90).select("row", "col", r("value", 4).alias("value"))


@query(f"WITH {_GRID} SELECT row - 50 AS row, col - 30 AS col, z FROM g WHERE row BETWEEN 50 AND 149 AND col BETWEEN 30 AND 109")
def window_crop(spark, d):
    return raster.crop(_grid(spark, d), 50, 30, 100, 80)
